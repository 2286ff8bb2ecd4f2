"""What building an index shuffles and sorts."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skimlight.engine import SearchEngine
from skimlight.functions.text import analyzers
from skimlight.operators import changes as C
from skimlight.operators import postings as P
from skimlight.sources import store as S

SIMPLE = analyzers({"default": {"analyzer": "simple"}})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_texts(spark):
    """Against a count by hand; a text has its postings without a shuffle, and the words are cut out of it once."""
    texts = {"a": "b a b", "c": "", "d": " ... ", "e": "x", "f": " ".join(["z", "y"] * 300)}
    rows = spark.createDataFrame([(d, "text", t) for d, t in texts.items()] + [("n", "text", None), ("a", "documentId", "a")], "docid string, field string, text string")
    want = set()
    for docid, text in texts.items():
        words = re.findall("[a-z0-9]+", text)
        want |= {("text", w, docid, tuple(i for i, x in enumerate(words, 1) if x == w), words.count(w), len(words)) for w in words}
    want.add(("documentId", "a", "a", (1,), 1, 1))
    got = P.postings_of_texts(rows, SIMPLE)
    assert sorted((r.field, r.term, r.docid, tuple(r.positions), r.tf, r.doc_len) for r in got.collect()) == sorted(want)
    steps = plan(got)
    assert "Exchange" not in steps and "Aggregate" not in steps and steps.count("regexp_extract_all") == 1


def test_texts_of_one_document_in_several_rows(spark):
    rows = spark.createDataFrame([("a", "text", "x y"), ("a", "text", "y y x x"), ("b", "text", "x")], "docid string, field string, text string").repartition(3)
    got = {(r.term, r.docid): (list(r.positions), r.tf, r.doc_len) for r in P.build_postings(rows, SIMPLE).collect()}
    assert got == {("x", "a"): ([1, 3, 4], 3, 4), ("y", "a"): ([1, 2], 2, 4), ("x", "b"): ([1], 1, 1)}


def test_fields_are_folded_in_one_shuffle(spark):
    rows = [(0, "a", False, 1, {"text": "x"}, {0: 1.0}, {"c": "d"}), (1, "a", False, None, {"text": "y"}, None, None), (2, "b", False, 1, {"text": "z"}, None, None), (3, "b", True, None, None, None, None)]
    log = spark.createDataFrame(rows, C.CHANGE_SCHEMA.replace("index_code string, ", "")).repartition(2)
    folded = C.fold_fields(log)
    assert plan(folded).count("Exchange hashpartitioning") == 1 and "Join" not in plan(folded)
    assert sorted(folded.collect()) == sorted(C.fold(log).select("docid", "seq", "deleted", "fields").collect())


def test_postings_have_more_ranges_with_more_documents(spark, tmp_path, monkeypatch):
    """A range stays small enough to be sorted in memory, however few partitions a shuffle has."""
    monkeypatch.setattr(S, "RANGE_BYTES", 500)
    store = S.Store(spark, str(tmp_path / "index"))
    documents = spark.range(400).selectExpr("cast(id as string) as docid", "map('text', concat('word', hash(id), ' and')) as fields")
    tables = {"documents": documents, "postings": lambda d: P.postings_of_texts(P.long_fields(d), SIMPLE)}
    store.manifest.base = store.write(tables)
    assert len(store.read("postings").inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = P.build_postings(P.long_fields(documents), SIMPLE)
    assert sorted(map(str, store.read("postings").collect())) == sorted(map(str, want.collect()))


def test_changes_do_not_read_stored_texts(spark, tmp_path):
    """New fields replace all of a document's, so a change needs the stored variables and categories only."""
    engine = SearchEngine(spark, str(tmp_path / "index"), n_vars=2)
    schema = C.CHANGE_SCHEMA.replace("index_code string, ", "")

    def apply(*rows):
        engine.apply(spark.createDataFrame(list(rows), schema))

    apply(*[(0, d, False, 5, {"text": f"old {d}"}, {0: 1.0}, {"c": "x"}) for d in ("a", "b", "c", "d")])
    state = engine._state_of(spark.createDataFrame([("a",)], "docid string"))
    assert "/documents" not in plan(state) and state.first().fields is None
    # also with a number below those of most logs
    apply((1, "a", False, None, None, {1: 2.0}, None), (-7, "b", False, None, {"text": "new"}, None, None), (1, "c", True, None, None, None, None))
    apply((1, "d", True, None, None, None, None), (2, "d", False, 6, {"text": "back"}, None, None))
    assert {r.docid: r.fields for r in engine.documents().collect()} == {"a": {"text": "old a"}, "b": {"text": "new"}, "d": {"text": "back"}}
    assert {r.docid: (list(r.vars), r.cats, r.ts) for r in engine.dynamic().collect()} == {
        "a": ([1, 2], {"c": "x"}, 5), "b": ([1, 0], {"c": "x"}, 5), "d": ([0, 0], {}, 6),
    }


def test_postings_are_sorted_where_they_are_made(spark, tmp_path, monkeypatch):
    """A document's postings are in one file, in the order of terms: texts are dealt out at most, and postings never."""
    monkeypatch.setattr(S, "RANGE_BYTES", 500)
    documents = spark.range(400).selectExpr("cast(id as string) as docid", "map('text', concat('word', hash(id), ' and the word', id % 7)) as fields")
    postings = P.postings_of_texts(P.long_fields(documents), SIMPLE)
    want = sorted(map(str, postings.collect()))
    # made from the stored documents, and given as rows as when a base is rewritten
    for kind, made in (("made", lambda d: P.postings_of_texts(P.long_fields(d), SIMPLE)), ("given", postings.repartition(3, "term"))):
        store = S.Store(spark, str(tmp_path / kind))
        store.manifest.base = store.write({"documents": documents, "postings": made})
        files = [[r for r in spark.read.parquet(f).collect()] for f in store.read("postings").inputFiles()]
        assert sorted(str(r) for rows in files for r in rows) == want
        assert sum(len({r.docid for r in rows}) for rows in files) == 400
        assert all(rows == sorted(rows, key=lambda r: (r.term, r.field, r.docid)) for rows in files)
        assert len(files) > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(("words", "size"), [(3, 8_000), (3000, 600_000)])
def test_stored_documents_are_not_shuffled_for_their_postings(spark, tmp_path, monkeypatch, words, size):
    """However many there are: they are read in small parts, also from few files, of long texts, and of long ones after short ones."""
    monkeypatch.setattr(S, "RANGE_BYTES", size)
    setting = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(setting), []
    text = f"array_join(transform(sequence(1, if(id % 800 = 0, 1, {words})), i -> concat('w', abs(xxhash64(id, i)))), ' ')"
    documents = spark.range(0, 1600, 1, 2).where(f"{words} = 3 or id % 16 = 0").selectExpr("cast(id as string) as docid", f"map('text', {text}) as fields")

    def made(stored):
        seen.append(P.postings_of_texts(P.long_fields(stored), SIMPLE))
        return seen[0]

    store = S.Store(spark, str(tmp_path / "index"))
    store.manifest.base = store.write({"documents": documents, "postings": made})
    assert "Exchange" not in plan(seen[0]) and spark.conf.get(setting) == before
    rows = store.read("postings").withColumn("file", F.input_file_name()).groupBy("docid", "file").agg(F.count("term").alias("n")).collect()
    files = Counter(r.file for r in rows)
    n = documents.count()
    assert len(rows) == len({r.docid for r in rows}) == n and len(files) > 4 and max(files.values()) <= n / 3
    assert sum(r.n for r in rows) == (n - 2) * (words + 1) + 2 * 2
