import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import test_mixing  # noqa: E402
from .helpers import DOCS, empty, odd_documents, table  # noqa: E402
from .test_language_id import corpus  # noqa: E402
from .test_mixing import brute as mixed  # noqa: E402
from .test_simhash import components, jaccard  # noqa: E402


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages_against_brute_force(spark, monkeypatch):
    rows = corpus(60) + [(1000 + (i or 0) if i is not None else None, t, lang, s, n) for i, t, lang, s, n in odd_documents()]
    docs = table(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]

    out = rows_of(found := stage["language_id"](spark, docs, ""))
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert [(r[0], r[1]) for r in out] == [(r[0], r[1]) for r in sorted(want, key=repr)] and all(r[2] for r in out)
    assert found.columns == docs.columns

    before = out
    out = rows_of(found := stage["exact_dedup"](spark, table(spark, before, DOCS), ""))
    first = {}
    for r in sorted(before, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(r[1]), r)
    assert [(r[0], r[1]) for r in out] == [(r[0], r[1]) for r in sorted(first.values(), key=repr)] and found.columns == docs.columns

    before = out
    out = rows_of(found := stage["simhash_near_dedup"](spark, table(spark, before, DOCS), ""))
    long = [i for i, r in enumerate(before) if len(r[1].split()) >= 5]
    links = [(i, j) for i, j in itertools.combinations(long, 2) if jaccard(before[i][1], before[j][1]) >= 0.8]
    part = components(range(len(before)), links)
    groups = {}
    for i, c in part.items():
        groups.setdefault(c, []).append(before[i])
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert len(want) < len(before) and out == sorted(want, key=repr) and found.columns == docs.columns

    before = out
    monkeypatch.setattr(test_mixing, "ORDER", keys := {})
    for r in (found := corpus_pipeline._keyed(docs := table(spark, before, DOCS))).collect():
        key = r[corpus_pipeline._KEY]
        keys[r.doc_id] = "{" + f"{str(key.without).lower()}, {'null' if key.id is None else key.id}, {key.h}" + "}"
    out = rows_of(found := stage["mixing"](spark, docs, ""))
    chosen = {r[0] for r in mixed(before, corpus_pipeline.BUDGET_PERMILLE, 1)}
    assert len({r[0] for r in before}) == len(before)
    assert 0 < len(out) < len(before) and out == sorted((r for r in before if r[0] in chosen), key=repr) and found.columns == docs.columns
    tokens = lambda rs: sum(len(r[1].split()) for r in rs)
    assert tokens(out) <= 0.8 * tokens(before)

    # packing: the pieces are the tokenizer's ids in order, and no sequence has a gap
    packed = stage["packing"](spark, table(spark, out, DOCS), "").collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out:
        ids = [*model.encode(r[1], add_special_tokens=False).ids, 0]
        own = sorted((p for p in packed if p.doc_id == r[0]), key=lambda p: p.piece)
        assert [(p.piece, p.start, p.length) for p in own] == [(k, at, len(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in own)
    sequences = {}
    for p in packed:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) == -(-sum(p.length for p in packed) // 2048)  # the lower bound, on these


def odd(spark):
    a, b = "one two three four five six", "another text of a few words here"
    rows = [(1, None, "en", "src1", 0), (1, None, "en", "src1", 0), (2, "", None, None, None), (None, a, "en", "src0", 1), (None, a, "en", "src0", 1), (3, "!!! 12", "en", "src1", 0),
            (4, b, "de", "src2", 2), (4, b, "de", "src3", 2), (5, "word " * 30_000, "en", "src1", 0), (6, " \t\n", "en", "src1", 0)]
    return table(spark, rows, clashing=True)


@pytest.mark.parametrize(("name", "left"), [("exact_dedup", 6), ("simhash_near_dedup", 5), ("mixing", None), ("packing", None)])
def test_odd_rows_in_each_stage(spark, name, left):
    docs = odd(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    rows = out.collect()
    if name == "packing":
        assert len(rows) == 10 + 30_001 // 2048 and {r.doc_id for r in rows} == {1, 2, None, 3, 4, 5, 6}
    else:
        assert out.columns == docs.columns and all(r["rank"] == "clash" for r in rows)
        assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    if left is not None:
        assert len(rows) == left
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), "").collect() == []


def test_exact_stage_keeps_the_same_row_each_time(spark):
    """Of rows with one id and text but different columns, the choice does not depend on their order."""
    rows = [(1, "a b", lang, source, n) for lang in ("en", "de") for source in ("s", "t") for n in range(3)]
    kept = {tuple(corpus_pipeline.exact_stage(spark, table(spark, random.Random(i).sample(rows, len(rows))), "").first()) for i in range(3)}
    assert len(kept) == 1


@pytest.mark.parametrize("limit", [-1, 4 << 20])
def test_both_ways_of_leaving(spark, monkeypatch, limit):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_BYTES", limit)
    docs = odd(spark)
    assert corpus_pipeline.exact_stage(spark, docs, "").count() == 6


def test_repeated_ids_and_clashing_columns(spark):
    a, b = "one two three four five six", "another text of a few words here"
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (1, a, "en", "s", 0), (None, b + " x", "en", "s", 0)]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, table(spark, rows, clashing=True), "")
        assert "clash" in docs.first().asDict().values()
        rows = [tuple(r)[:5] for r in docs.collect()]
    assert sorted(r[1] for r in rows) == sorted([a, b, b + " x"])


def test_run(spark, tmp_path):
    table(spark, corpus(80)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
