import math
import random

import pytest

from skimlight.functions.text import analyzers
from skimlight.operators.postings import build_postings, term_stats
from skimlight.plans.match import last_prefix_term, match, terms_of
from skimlight.plans.query import And, Difference, InvalidQuery, MatchAll, Or, Phrase, Prefix, Term, TermRange, parse

SIMPLE = analyzers({"default": {"analyzer": "simple"}})


def index(spark, docs, field="text"):
    rows = spark.createDataFrame([(d, field, t) for d, t in docs], "docid string, field string, text string")
    return build_postings(rows, SIMPLE)


def scores(postings, query, docs=None):
    node = parse(query) if isinstance(query, str) else query
    return {r.docid: r.R for r in match(postings, node, docs).collect()}


def test_scores(spark):
    own = index(spark, [("1", "aaa"), ("2", "aaa bbb"), ("3", "aaa aaa bbb"), ("4", "aaa bbb ccc eee")])
    found = scores(own, "aaa")
    assert [round(found[d], 6) for d in "1234"] == [1.0, 0.707107, 0.816497, 0.5]
    assert scores(own, '"aaa bbb"')["2"] == pytest.approx(1 + 2 * math.sqrt(0.5))
    assert scores(own, Prefix("text", "a"))["3"] == pytest.approx(math.sqrt(2 / 3))


def test_named_field_and_relevance(spark):
    """The share of a document that is the term decides."""
    docs = [("1", "slate roof"), ("2", "slate slate roof"), ("3", "slate roof over an old barn")]
    found = scores(index(spark, docs, "title"), "title:slate")
    assert found == pytest.approx({"1": math.sqrt(1 / 2), "2": math.sqrt(2 / 3), "3": math.sqrt(1 / 6)}) and scores(index(spark, docs, "title"), "slate") == {}


def test_phrase_with_gap_and_match_all(spark):
    own = index(spark, [("1", "a x b"), ("2", "a b"), ("3", "")])
    docs = spark.createDataFrame([("1",), ("2",), ("3",)], "docid string")
    assert set(scores(own, Phrase("text", ("a", "b"), (0, 2)))) == {"1"}
    assert scores(own, MatchAll(), docs) == {"1": 1.0, "2": 1.0, "3": 1.0}
    assert set(scores(own, Difference(MatchAll(), Term("text", "x")), docs)) == {"2", "3"}


def test_ranges_are_refused(spark):
    with pytest.raises(InvalidQuery, match="Range queries"):
        match(index(spark, [("1", "a")]), TermRange("text", "a", "b"))


def test_prefix_cap(spark):
    own = index(spark, [("1", "ba bb"), ("2", "bc"), ("3", "bd be")])
    stats = term_stats(own)
    assert last_prefix_term(stats, "text", "b", 3) == "bc"
    assert last_prefix_term(stats, "text", "b", 5) is None
    assert last_prefix_term(stats, "text", "x", 3) is None


def naive(docs, node):
    """(score by doc) of the tree, merged node by node."""
    out = {}
    match node:
        case Term():
            for d, ws in docs.items():
                if n := ws.count(node.term):
                    out[d] = math.sqrt(n / len(ws))
        case Prefix():
            for d, ws in docs.items():
                if n := sum(w.startswith(node.prefix) for w in ws):
                    out[d] = math.sqrt(n / len(ws))
        case Phrase():
            for d, ws in docs.items():
                if any(tuple(ws[i : i + len(node.terms)]) == node.terms for i in range(len(ws))):
                    out[d] = 1 + sum(math.sqrt(ws.count(t) / len(ws)) for t in node.terms)
        case And() | Or() | Difference():
            a, b = naive(docs, node.left), naive(docs, node.right)
            keys = a.keys() & b.keys() if isinstance(node, And) else a.keys() | b.keys() if isinstance(node, Or) else a.keys() - b.keys()
            for d in keys:
                out[d] = a.get(d, 0) * node.left.boost + (0 if isinstance(node, Difference) else b.get(d, 0) * node.right.boost)
    return out


def random_tree(rng, depth):
    boost = rng.choice([1.0, 1.0, 2.0, 0.5])
    if depth == 0 or rng.random() < 0.2:
        words = "abcd"
        kind = rng.randrange(4)
        if kind == 0:
            return Phrase("text", (rng.choice(words) * 2, rng.choice(words) * 2), (0, 1), boost=boost)
        return Prefix("text", rng.choice(words), boost=boost) if kind == 1 else Term("text", rng.choice(words) * rng.choice([1, 2]), boost=boost)
    return rng.choice([And, Or, Difference])(random_tree(rng, depth - 1), random_tree(rng, depth - 1), boost=boost)


def test_one_pass_equals_node_by_node(spark):
    rng = random.Random(7)
    docs = {f"d{i}": [rng.choice("abcd") * rng.choice([1, 2]) for _ in range(rng.randrange(1, 9))] for i in range(40)}
    own = index(spark, [(d, " ".join(ws)) for d, ws in docs.items()]).persist()
    for _ in range(25):
        node = random_tree(rng, 3)
        want = {d: s / node.norm for d, s in naive(docs, node).items()}
        assert scores(own, node) == pytest.approx(want), node


def as_text(node):
    """A query string that means the tree."""
    match node:
        case Phrase():
            text = '"' + " ".join(node.terms) + '"'
        case Prefix():
            text = node.prefix + "*"
        case Term():
            text = node.term
        case And() | Or():
            text = f"({as_text(node.left)} {'AND' if isinstance(node, And) else 'OR'} {as_text(node.right)})"
        case Difference():
            text = f"({as_text(node.left)} -{as_text(node.right)})"
    return text if node.boost == 1 else f"{text}^{node.boost}"


def test_query_strings_equal_node_by_node(spark):
    rng = random.Random(8)
    docs = {f"d{i}": [rng.choice("abcd") * rng.choice([1, 2]) for _ in range(rng.randrange(1, 9))] for i in range(40)}
    own = index(spark, [(d, " ".join(ws)) for d, ws in docs.items()]).persist()
    some = 0
    for _ in range(40):
        node = random_tree(rng, rng.choice([1, 2, 3]))
        want = {d: s / node.norm for d, s in naive(docs, node).items()}
        assert scores(own, as_text(node)) == pytest.approx(want), as_text(node)
        some += bool(want)
    assert some > 10


def test_postings_of_a_query_give_its_matches(spark):
    rows = spark.createDataFrame([("1", "text", "a b ab"), ("2", "text", "b c"), ("3", "text", "d")], "docid string, field string, text string")
    for query in ("a OR b", '"b ab"', "a* -c", "x"):
        asked = parse(query)
        assert scores(build_postings(rows, SIMPLE, wanted=terms_of(asked)), asked) == scores(build_postings(rows, SIMPLE), asked)


def test_one_shuffle_by_document(spark, tmp_path):
    path = str(tmp_path / "postings")
    index(spark, [("1", "a b c"), ("2", "b c")]).write.parquet(path)
    plan = match(spark.read.parquet(path), parse("(a OR b) AND c -d"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters: [" in plan and "Join" not in plan
