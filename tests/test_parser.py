import pytest

from skimlight.functions.text import spans
from skimlight.plans.query import And, Difference, InvalidQuery, Or, Phrase, Prefix, Term, parse, quote_phrases


def t(x, **k):
    return Term("text", x, **k)


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("foo", t("foo")),
        ("foo bar", And(t("foo"), t("bar"))),
        ("a b OR c", Or(t("a"), Or(t("b"), t("c")))),
        ("a OR b c", Or(t("a"), And(t("b"), t("c")))),
        ("a b -c", Difference(And(t("a"), t("b")), t("c"))),
        ("a NOT b", Difference(t("a"), t("b"))),
        ("title:foo^2.5", Term("title", "foo", boost=2.5)),
        ("(a b)^2", And(t("a"), t("b"), boost=2.0)),
        ("title:(a b)", And(Term("title", "a"), Term("title", "b"))),
        ('"foo bar"~3', Phrase("text", ("foo", "bar"), (0, 1))),
        ("Fo*", Prefix("text", "fo")),
        ("wi-fi", Phrase("text", ("wi", "fi"), (0, 1))),
        ("a && b || c", Or(t("a"), Or(t("b"), t("c")))),
        (r"a\:b", Phrase("text", ("a", "b"), (0, 1))),
        ("Fußball", t("fussball")),
    ],
)
def test_trees(query, tree):
    assert parse(query) == tree


def test_accepts():
    assert parse('foo bar AND (foobar OR barfoo) -foofoo +"barbar"')


@pytest.mark.parametrize("query", ['"', '""', "", "-a", "(a", "a)", "a AND", "fo?o", "f*o", "*", "a~", "[a TO b]", "AND a", "title:"])
def test_rejects(query):
    with pytest.raises(InvalidQuery):
        parse(query)


def test_pure_negative():
    with pytest.raises(InvalidQuery, match="No positive clauses."):
        parse("-a -b")


def test_equality_and_terms():
    assert And(t("a"), t("b")) == And(t("b"), t("a")) and Or(t("a"), t("b")) != And(t("a"), t("b"))
    assert Difference(t("a"), t("b")) != Difference(t("b"), t("a"))
    assert parse('a "b c" d* -e').positive_terms() == {("text", x) for x in ("a", "b", "c", "d*")}


def test_norms():
    assert parse("a^2 OR b").norm == 3 and parse("(a b)^2 c").norm == 5 and parse("a^3 -b^9").norm == 3


def test_token_positions():
    assert [w for w, _, _ in spans("word1 word2 word3. word4 5.6")] == ["word1", "word2", "word3", "word4", "5.6"]


def test_known_phrases():
    assert quote_phrases("cheap new york hotel", ["new york", "york hotel", "new york hotel"]) == 'cheap "new york hotel"'
    assert quote_phrases('"new york" newyork New York', ["new york"]) == '"new york" newyork "New York"'
