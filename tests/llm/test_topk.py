import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimlight.llm import topk

from .helpers import CLASHING

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, scale=64, every=20):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for n, (j, w) in enumerate(good) if n != at and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, clashing=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    if clashing:
        df = df.withColumns({c: F.lit(1) for c in CLASHING})
    return sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 20 == 0, k=k).collect())


def vectors(rng, n, d, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "spread"), [(150, 8, 0.3), (150, 3, 0.02), (61, 1, 1.0), (80, 6, 1e4), (60, 4, 1e7), (3, 4, 1)])
def test_brute(spark, monkeypatch, n, d, spread):
    monkeypatch.setattr(topk, "SLICE_ROWS", 40)
    monkeypatch.setattr(topk, "GROUP_ROWS", 3)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rows = vectors(random.Random(n), n, d, spread)
    assert run(spark, rows) == brute(rows, 5)


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = vectors(rng, 50, 4)
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [float("nan")] * 4), (80, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (100, [1.0, 2.0]), (101, [3.0, 4.0]),
             (140, []), (141, []), (20, rows[20][1]), (7, rows[7][1])]
    rows += [(200 + i, [0.5] * 4) for i in range(40)]  # ties
    assert run(spark, rows, clashing=True) == brute(rows, 5)
    assert run(spark, []) == []


def test_scores_beyond_a_long(spark):
    assert run(spark, [(0, [1e30]), (1, [1e30]), (2, [-1e30])]) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 1 - 2**63)]


def test_bounds_hold_and_close_in():
    rng = np.random.default_rng(1)
    x, q = rng.normal(0, 30, (300, 12)).round(), rng.normal(0, 30, (20, 12)).round()
    lists, full, before = topk.Lists(x), q @ x.T, np.inf
    assert (lists.most(np.maximum(q, 0), np.minimum(q, 0)) >= full.max(axis=1)).all()
    for depth in (1, 37, 150, 300):
        lower, upper = lists.bounds(np.maximum(q, 0), np.minimum(q, 0), depth)
        assert (lower <= full).all() and (full <= upper).all() and (upper - lower).mean() < before
        before = (upper - lower).mean()
    assert before == 0  # all is read


def test_few_candidates_are_left():
    rng = np.random.default_rng(1)
    x, q = rng.normal(0, 30, (1000, 16)).round(), rng.normal(0, 30, (20, 16)).round()
    own = np.zeros((20, 1000), bool)
    own[:, 3] = True
    full = q @ x.T
    full[own] = -np.inf
    tenth = np.sort(full, axis=1)[:, -10]
    for need in (np.full(20, -np.inf), tenth.copy()):
        may = topk.candidates_of(topk.Lists(x), q, own, need, 10)
        assert not (may & own).any() and may[full >= tenth[:, None]].all() and may.mean() < 0.15


def test_blocks_are_left_on_skewed_data():
    """Few long vectors: most candidates are never scored, and their blocks' lists not read."""
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 1, (6000, 16)) * 200 * rng.pareto(1.5, (6000, 1))).round()
    q = rng.normal(0, 64, (50, 16)).round()
    rows = np.arange(6000)
    at, ids, score, share = topk.search_slice(q, -1 - np.arange(50), x, rows, rows, 20)
    full = q @ x.T
    assert share < 0.05
    for i in range(50):
        want = np.lexsort((rows, -full[i]))[:20]
        assert ids[at == i].tolist() == want.tolist() and score[at == i].tolist() == full[i][want].tolist()
    lists = topk.Lists(x[np.argsort(-(x**2).sum(axis=1))][3000:])
    assert (lists.most(np.maximum(q, 0), np.minimum(q, 0)) < np.sort(full, axis=1)[:, -20]).mean() > 0.95
