"""Scoring formulas as Columns.

A formula is an arithmetic expression over the relevance, the age, document variables
and query variables, for example ``relevance * log(doc.var[0] + 1) - age / 3600``. Its
syntax is a subset of Python's, so Python's own parser reads it; what is left here is to
turn the tree into a Column, which Catalyst folds and compiles with the rest of the
query. Arithmetic is that of IEEE doubles: no error and no null for a division by zero
or the logarithm of a negative number.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """The formula is not valid."""


class MissingQueryVariable(LookupError):
    """A query variable that the formula reads was not given."""


RELEVANCE = {"relevance", "rel", "R", "r"}
AGE = {"age", "A", "a"}
FUNCTIONS = {"log": 1, "sqrt": 1, "abs": 1, "pow": 2, "min": 2, "max": 2, "bit": 2, "km": 4, "miles": 4}
#: Kilometres and miles of a degree (fixed values).
KM, MILES = 111.133, 69.055
_INT = (-(2.0**31), 2.0**31 - 1)


def _tree(text: str) -> ast.expr:
    if re.search(r"[^\w\s.,()\[\]+\-*/=!<>]|//|\*\*|\b\d+\.?\d*[A-Za-z_]|(?<![\w\])])\.\d|\d\.(?!\d)|[A-Za-z]\s+\(|[A-Za-z]\s*\n\s*\(", text):
        raise FormulaError(f"Syntax Error: {text}")
    code = re.sub(r"<>", "!=", text)
    code = re.sub(r"(?<![=!<>])=(?!=)", "==", code)
    code = re.sub(r"\bif\(", "if_(", code)
    code = re.sub(r"(?<![\w.])0+(?=\d)", "", code)
    try:
        return ast.parse(f"({code.strip()}\n)", mode="eval").body
    except (SyntaxError, ValueError) as error:
        raise FormulaError(f"Syntax Error: {text}") from error


def _index(node: ast.expr) -> int:
    if isinstance(node, ast.Constant) and type(node.value) is int:
        return node.value
    raise FormulaError("Syntax Error: an index is a whole number")


def _operand(node: ast.expr) -> tuple[str, int] | None:
    """('relevance' | 'age' | 'doc' | 'query', index) if the node is one."""
    if isinstance(node, ast.Name):
        return ("relevance", 0) if node.id in RELEVANCE else ("age", 0) if node.id in AGE else None
    if isinstance(node, ast.Attribute) and ast.unparse(node) == "doc.age":
        return "age", 0
    if isinstance(node, ast.Subscript):
        name = ast.unparse(node.value)
        kind = "doc" if name in ("doc.var", "dvar", "D", "d") else "query" if name in ("query.var", "qvar", "Q", "q") else None
        return (kind, _index(node.slice)) if kind else None
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("boost", "B", "b") and len(node.args) == 1:
        return "doc", _index(node.args[0])
    return None


class _Columns:
    """Operations on Columns."""

    number = staticmethod(lambda x: F.lit(float(x)))
    add, sub, mul = (staticmethod(f) for f in (lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b))
    neg = staticmethod(lambda a: -a)

    @staticmethod
    def div(a: Column, b: Column) -> Column:
        endless = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
        return F.when(b == 0, endless).otherwise(F.try_divide(a, b))

    log = staticmethod(lambda x: F.when(F.isnan(x), x).when(x > 0, F.ln(x)).when(x == 0, float("-inf")).otherwise(float("nan")))
    sqrt, abs = staticmethod(F.sqrt), staticmethod(F.abs)

    @staticmethod
    def _int(x: Column) -> Column:
        """To a whole number, as narrowing does: towards zero, saturated, NaN to 0."""
        return F.when(F.isnan(x), 0).otherwise(F.least(F.greatest(x, F.lit(_INT[0])), F.lit(_INT[1])).cast("int"))

    @classmethod
    def pow(cls, x: Column, e: Column) -> Column:
        e = cls._int(e)
        return F.when(e == 0, 1.0).when((x == 0) & (e < 0), float("inf")).otherwise(F.pow(x, e))

    @staticmethod
    def min(a: Column, b: Column) -> Column:
        return F.when(F.isnan(a) | F.isnan(b), b).otherwise(F.least(a, b))

    @staticmethod
    def max(a: Column, b: Column) -> Column:
        return F.when(F.isnan(a) | F.isnan(b), b).otherwise(F.greatest(a, b))

    @classmethod
    def bit(cls, v: Column, i: Column) -> Column:
        # the sign bit is never above zero; shifts count modulo 32
        mask = F.call_function("shiftleft", F.lit(1), F.pmod(cls._int(i), F.lit(32)).cast("int"))
        return F.when(cls._int(v).bitwiseAND(mask) > 0, 1.0).otherwise(0.0)

    @classmethod
    def distance(cls, unit: float, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        outside = F.lit(False)
        for x, most in ((lat1, 90), (lat2, 90), (lon1, 180), (lon2, 180)):
            outside |= ~F.isnan(x) & (F.abs(x) > most)
        middle = (cls._int(lat1 + lat2) / 2).cast("int")  # both steps towards zero
        wide = F.pow(F.cos(F.radians(middle.cast("double"))), F.lit(2.0))
        return F.when(outside, float("inf")).otherwise(unit * F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2) * wide))

    @staticmethod
    def compare(op: str, a: Column, b: Column) -> Column:
        odd = F.isnan(a) | F.isnan(b)
        if op == "==":
            return ~odd & (a == b)
        # with a NaN all others hold
        return odd | {"!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    choose = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))


class _Checked:
    """Operations without values, for a walk that only checks."""

    def __getattr__(self, name: str):
        return lambda *args: None


_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div"}
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class Formula:
    """A parsed formula; ``column`` gives its value."""

    def __init__(self, text: str):
        self.text = text
        self._root = _tree(text)
        self.query_variables: set[int] = set()
        self.document_variables: set[int] = set()
        self._build(self._root, _Checked(), self._note)

    def _note(self, kind: str, i: int) -> None:
        {"doc": self.document_variables, "query": self.query_variables}.get(kind, set()).add(i)

    def _build(self, node: ast.expr, on: object, read: Callable[[str, int], object]):
        def go(n):
            return self._build(n, on, read)

        if (what := _operand(node)) is not None:
            return read(*what)
        match node:
            case ast.Constant(value=int() | float() as x) if type(x) is not bool:
                return on.number(x)
            case ast.BinOp(left, op, right) if type(op) in _BINARY:
                return getattr(on, _BINARY[type(op)])(go(left), go(right))
            case ast.UnaryOp(ast.USub(), x):
                return on.neg(go(x))
            case ast.Call(ast.Name("if_"), [ast.Compare(a, [op], [b]), yes, no], []) if type(op) in _COMPARE:
                return on.choose(on.compare(_COMPARE[type(op)], go(a), go(b)), go(yes), go(no))
            case ast.Call(ast.Name(name), args, []) if FUNCTIONS.get(name) == len(args):
                values = [go(a) for a in args]
                if name in ("km", "miles"):
                    return on.distance(KM if name == "km" else MILES, *values)
                return getattr(on, name)(*values)
        raise FormulaError(f"Syntax Error: {self.text}")

    def column(
        self, relevance: Column, age: Column, doc_var: Callable[[int], Column], query_vars: Mapping[int, float] | Sequence[float] = ()
    ) -> Column:
        """A double Column. Query variables become literals; one that is missing raises before the query runs."""
        given = dict(query_vars) if isinstance(query_vars, Mapping) else dict(enumerate(query_vars))
        if missing := sorted(self.query_variables - set(given)):
            raise MissingQueryVariable(f"query variable {missing[0]} is not given")

        def read(kind: str, i: int) -> Column:
            if kind == "query":
                return F.lit(float(given[i]))
            return {"relevance": relevance, "age": age}[kind].cast("double") if kind != "doc" else doc_var(i).cast("float").cast("double")

        return self._build(self._root, _Columns, read)
