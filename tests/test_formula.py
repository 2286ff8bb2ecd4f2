import math
import random

import pytest
from pyspark.sql import functions as F

from skimlight.functions.formula import Formula, FormulaError, MissingQueryVariable

VALUES = [0.0, 1.0, -1.0, 2.5, -3.0, 0.5, 40.0, -75.25, 2147483648.0, float("nan"), float("inf"), float("-inf")]


class Floats:
    """The same operations on Python floats."""

    number = staticmethod(float)
    add, sub, mul = (staticmethod(f) for f in (lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b))
    neg = staticmethod(lambda a: -a)

    @staticmethod
    def div(a: float, b: float) -> float:
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.inf if a > 0 else -math.inf
        return a / b

    log = staticmethod(lambda x: math.log(x) if x > 0 else x if math.isnan(x) else -math.inf if x == 0 else math.nan)
    sqrt = staticmethod(lambda x: math.sqrt(x) if x >= 0 else math.nan)
    abs = staticmethod(abs)

    @staticmethod
    def _int(x: float) -> int:
        return 0 if math.isnan(x) else int(min(max(x, -(2.0**31)), 2.0**31 - 1))

    @classmethod
    def pow(cls, x: float, e: float) -> float:
        n = cls._int(e)
        if n == 0:
            return 1.0
        try:
            return math.inf if x == 0 and n < 0 else float(x) ** n
        except OverflowError:
            return -math.inf if x < 0 and n % 2 else math.inf

    min = staticmethod(lambda a, b: a if a < b else b)
    max = staticmethod(lambda a, b: a if a > b else b)

    @classmethod
    def bit(cls, v: float, i: float) -> float:
        shift = cls._int(i) % 32
        return 1.0 if shift != 31 and cls._int(v) & (1 << shift) else 0.0

    @classmethod
    def distance(cls, unit: float, lat1: float, lon1: float, lat2: float, lon2: float) -> float:
        if any(abs(x) > most for x, most in ((lat1, 90), (lat2, 90), (lon1, 180), (lon2, 180))):
            return math.inf
        middle = int(cls._int(lat1 + lat2) / 2)
        return unit * math.sqrt((lat1 - lat2) ** 2 + (lon1 - lon2) ** 2 * math.cos(math.radians(middle)) ** 2)

    @staticmethod
    def compare(op: str, a: float, b: float) -> bool:
        odd = math.isnan(a) or math.isnan(b)
        if op == "==":
            return not odd and a == b
        return odd or {"!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    choose = staticmethod(lambda c, a, b: a if c else b)



def evaluate(text, relevance, age, doc_vars, query_vars={}):
    """A formula for one document in Python."""
    known = {"relevance": lambda i: relevance, "age": lambda i: float(age), "doc": lambda i: doc_vars.get(i, 0.0), "query": lambda i: query_vars[i]}
    f = Formula(text)
    return f._build(f._root, Floats, lambda kind, i: known[kind](i))


def column(text, df, query_vars=()):
    return Formula(text).column(F.col("R"), F.col("age"), lambda i: F.get("vars", F.lit(i)), query_vars)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(VALUES[:8]), rng.randrange(-100, 100000), [rng.choice(VALUES) for _ in range(3)]) for i in range(60)]
    return data, spark.createDataFrame(data, "id int, R double, age int, vars array<float>").persist()


def check(rows, text, query_vars={}):
    data, df = rows
    got = {r.id: r.s for r in df.select("id", column(text, df, query_vars).alias("s")).collect()}
    for i, r, age, v in data:
        want = evaluate(text, r, age, dict(enumerate(v)), query_vars)
        assert got[i] is not None, (text, r, age, v)
        same = got[i] == want or (math.isnan(want) and math.isnan(got[i])) or math.isclose(got[i], want, rel_tol=1e-12)
        assert same, (text, r, age, v, got[i], want)


@pytest.mark.parametrize(
    "text",
    [
        "R", "rel*2", "relevance + age/10 - -A", "d[0]/d[1]", "log(d[0])", "sqrt(d[0])", "pow(d[0], d[1])", "pow(d[0], 0.5)", "min(d[0], d[1])",
        "max(d[0], d[1])", "abs(d[0])", "bit(d[0], d[1])", "bit(age, 3)", "km(d[0], d[1], 10, 20)", "miles(d[0], d[1], d[2], 20)",
        "if(d[0] < d[1], 1, 2)", "if(d[0] == d[1], 1, 2)", "if(d[0] != d[1], 1, 2)", "if(d[0] >= d[1], d[2], -d[2])", "if(d[0] = 1, 1, 0)",
        "if(d[0] <> d[1], 1, 0)", "boost(1) + B(2) + b(0)", "doc.var[1] + dvar[0] + D[2]", "doc.age", "q[0] * query.var[1] + Q[0] - qvar[1]",
        "007 + 1.50", "2 - 3 - 4 * -2 / 4",
    ],
)
def test_columns_equal_floats(rows, text):
    check(rows, text, {0: 1.5, 1: -2.0})


def random_formula(rng, depth):
    if depth == 0:
        return rng.choice(["R", "A", "d[0]", "d[1]", "d[2]", "q[0]", "3", "0", "0.25"])
    a, b, c, e = (random_formula(rng, depth - 1) for _ in range(4))
    op = rng.choice(["<", "<=", ">", ">=", "==", "!="])
    return rng.choice([f"({a} + {b})", f"({a} - {b})", f"({a} * {b})", f"({a} / {b})", f"-{a}", f"log({a})", f"sqrt({a})", f"min({a}, {b})", f"max({a}, {b})", f"abs({a})", f"if({a} {op} {b}, {c}, {e})"])


def test_random_formulas(rows):
    rng = random.Random(11)
    for _ in range(40):
        check(rows, random_formula(rng, 3), {0: 2.0})


@pytest.mark.parametrize("text", ["", "1 +", "log (1)", "foo(1)", "log(1, 2)", "1e3", ".5", "d[R]", "1 < 2", "if(1, 2, 3)", "a ** 2", "x", "d[0", "'a'", "a // 2", "1.", "__import__('os')", "if(1 < 2 < 3, 1, 2)"])
def test_errors(text):
    with pytest.raises(FormulaError):
        Formula(text)


def test_missing_query_variable():
    with pytest.raises(MissingQueryVariable):
        Formula("q[2] + 1").column(F.lit(1.0), F.lit(1), lambda i: F.lit(0.0), {0: 1.0})


def great_circle(lat1, lon1, lat2, lon2):
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    return 6371 * math.acos(min(1.0, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)))


def test_distance_near_new_york():
    rng, good = random.Random(1), 0
    for _ in range(2000):
        p = [40.7 + rng.uniform(-0.5, 0.5), -74 + rng.uniform(-0.5, 0.5), 40.7 + rng.uniform(-0.5, 0.5), -74 + rng.uniform(-0.5, 0.5)]
        good += abs(evaluate("km(q[0], q[1], q[2], q[3])", 0, 0, {}, dict(enumerate(p))) / great_circle(*p) - 1) < 0.05
    assert good >= 1900


def test_distance_edges():
    def km(*p):
        return evaluate("km(q[0], q[1], q[2], q[3])", 0, 0, {}, dict(enumerate(p)))

    assert 0 < km(90, 180, -90, -180) < math.inf and km(90, 0, 90, 0) == 0 and km(91, 0, 0, 0) == math.inf and km(0, 181, 0, 0) == math.inf
