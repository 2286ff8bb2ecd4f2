import pytest
from pyspark.sql import functions as F

from skimlight.functions.snippets import snippet
from skimlight.functions.stemmer import stem
from skimlight.functions.text import analyzer, analyzers, register_analyzer, register_filter, spans
from skimlight.operators.postings import tokens


def terms(spark, text, config):
    row = spark.createDataFrame([(text,)], "t string").select(analyzer(config)(F.col("t")).alias("x")).first()
    return [(t.pos, t.term) for t in row.x]


def words(spark, text, config):
    return [t for _, t in terms(spark, text, config)]


def test_standard(spark):
    assert terms(spark, "bolt7 nut. washer, 12.5", "standard") == [(1, "bolt7"), (2, "nut"), (3, "washer"), (4, "12.5")]
    assert words(spark, "Straße ÉTÉ Æon señor", "standard") == ["strasse", "ete", "aeon", "senor"]
    assert words(spark, "Ｗｉｄｅ１２ x² H₂O l’eau", "standard") == ["wide12", "x2", "h2o", "l'eau"]


@pytest.mark.parametrize("text", ["bolt7 12.5 Straße's", "l'été À-côté 10.000,50", "it's o'clock. a.b.c"])
def test_driver_and_columns_agree(spark, text):
    assert words(spark, text, "standard") == [w for w, _, _ in spans(text)]


def test_stop_words_leave_holes(spark):
    assert terms(spark, "the cat of rome", {"analyzer": "simple", "stopwords": ["the", "of"]}) == [(2, "cat"), (4, "rome")]


def test_cjk(spark):
    assert words(spark, "東京都 Tokyo 水", "cjk") == ["東京", "京都", "tokyo", "水"]


def test_filters_and_registry(spark):
    assert words(spark, "running caresses", {"analyzer": "simple", "filters": [{"filter": "stem"}, {"filter": "truncate", "length": 3}]}) == ["run", "car"]
    register_analyzer("commas", lambda config: lambda c: F.transform(F.split(c, ","), lambda t, i: F.struct((i + 1).cast("int").alias("pos"), t.alias("term"))))
    register_filter("upper", lambda config: lambda c: F.transform(c, lambda t: F.struct(t["pos"].alias("pos"), F.upper(t["term"]).alias("term"))))
    assert words(spark, "a b,c", {"analyzer": "commas", "filters": [{"filter": "upper"}]}) == ["A B", "C"]


def test_per_field(spark):
    rows = spark.createDataFrame([("1", "text", "A b"), ("1", "code", "A b"), ("1", "documentId", "x Y")], "docid string, field string, text string")
    config = {"perField": {"code": {"analyzer": "keyword"}}, "default": {"analyzer": "simple"}}
    found = {(r.field, r.term) for r in tokens(rows, analyzers(config), ["code"]).collect()}
    assert found == {("text", "a"), ("text", "b"), ("code", "A b"), ("documentId", "x Y")}


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
     ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
     ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("Été", "Été")],
)
def test_stemmer(word, want):
    assert stem(word) == want


def test_snippet_escapes():
    got = snippet("a <tag> & another \"quoted\" word", {"another", "word"}, "lines")
    assert "<b>another</b>" in got and "&lt;tag&gt;" in got and "&amp;" in got


def test_snippet_lines():
    text = "".join(f"begin item{i} \n" for i in range(1000))
    got = snippet(text, {"item525"}, "lines")
    assert got.startswith("begin") and got.endswith("\n") and "<b>item525</b>" in got and len(got) < 1000


@pytest.mark.parametrize("term", ["strasse", "stra*"])
def test_snippet_folded(term):
    got = snippet("the long and narrow Straße leads down", {term})
    assert "<b>Stra&szlig;e</b>" in got and "narrow " in got and " leads" in got


def test_snippet_edges():
    assert snippet("nothing here", {"x"}) == "" and snippet("", {"x"}) == ""
    assert snippet("x" * 300, {"x" * 300}) == "<b>" + "x" * 300 + "</b>"
    with pytest.raises(ValueError):
        snippet("a", {"a"}, "other")
