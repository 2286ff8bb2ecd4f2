import math
import random
import zlib

import numpy as np

from skimlight.llm import quality

from .helpers import empty, odd_documents, table, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = ". ".join(words(rng, rng.randrange(4, 12)).capitalize() for _ in range(rng.randrange(3, 12)))
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: t.replace(" ", "*** ")])(text)
        docs.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = quality.quality_scores(table(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    mark = dict((i, q) for i, q, _ in labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == mark[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    # held-out labels change nothing
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = quality.quality_scores(table(spark, docs), spark.createDataFrame(flipped, LABELS)).collect()
    assert np.allclose([r.score for r in sorted(got, key=lambda r: r.doc_id)], [r.score for r in sorted(again, key=lambda r: r.doc_id)], atol=1e-6)


def test_bounded_sample(spark):
    docs, labels = corpus()
    got = quality.quality_scores(table(spark, docs), spark.createDataFrame(labels, LABELS), training_rows=150).collect()
    mark = dict((i, q) for i, q, _ in labels)
    assert np.mean([r.predicted == mark[r.doc_id] for r in got if r.held_out]) > 0.9


def test_odd_tables(spark):
    rows = odd_documents()
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 1, 0)], LABELS)
    got = quality.quality_scores(table(spark, rows, clashing=True), labels).collect()
    assert len(got) == len(rows) and {r.held_out for r in got if r.doc_id is None} == {True}
    assert len({r.score for r in got if r.doc_id in (15, 16, 17)}) == 1  # null and empty
    assert quality.quality_scores(empty(spark), labels).collect() == []
    assert {r.score for r in quality.quality_scores(table(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    rng = np.random.default_rng(1)
    s = rng.random(300)
    y = (rng.random(300) < s).astype(float)
    x, v = quality.isotonic(s, y)
    assert (np.diff(v) > 0).all() and (np.diff(x) > 0).all()
    assert np.isclose(v[0], min(y[np.argsort(s)][: i + 1].mean() for i in range(300)))


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    d = quality.N_STATISTICS
    w = rng.normal(0, 1 / 3.0, (d, 4096)) / np.sqrt(d) * 2
    m = quality.Model(np.zeros(d), np.ones(d), w, rng.uniform(0, 2 * np.pi, 4096), None, None, None)
    x = rng.normal(size=(20, d))
    z = m.features(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(-1) * (2 / 3) ** 2 / d
    assert np.abs(z @ z.T - np.exp(-gap / 2)).max() < 0.1


def test_statistics_use_the_whole_text():
    assert quality.statistics("a " * 50_000 + "!") != quality.statistics("a " * 50_000)
    assert quality.statistics(None) == quality.statistics("") == [0.0] * quality.N_STATISTICS


def minimax(y):
    """Isotonic regression as it is defined: the greatest of the least means of runs."""
    n = len(y)
    return np.array([max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_against_dense_ridge_and_isotonic(spark):
    """The summed equations, the cross-fitted calibration and the scores, from dense matrices."""
    docs, labels = corpus(120, seed=5)
    mark = {i: float(q) for i, q, _ in labels}
    rows = [([float(v) for v in quality.statistics(t)], mark[i], i % quality.PARTS) for i, t, *_ in docs]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, y double, part int"), features=40)
    x, y, half = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] % 2 for r in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1
    assert np.allclose(model.mean, mean) and np.allclose(model.spread, spread, atol=1e-6)
    z = np.array([[math.sqrt(2 / 40) * math.cos(v @ w + p) for w, p in zip(model.frequencies.T, model.phase, strict=True)] + [1.0] for v in np.clip((x - mean) / spread, -6, 6)])

    def ridge(z, y):
        lam = 1e-3 * max(1.0, len(z)) / z.shape[1]
        # least squares with the penalty as further rows
        return np.linalg.lstsq(np.vstack([z, math.sqrt(lam) * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]

    assert np.allclose(z @ model.weights, z @ ridge(z, y), atol=1e-3)
    crossed = [ridge(z[half == 1], y[half == 1]), ridge(z[half == 0], y[half == 0])]
    s = np.where(half == 0, z @ crossed[0], z @ crossed[1])
    order = np.argsort(s, kind="stable")
    want = minimax(y[order])
    steps, values = quality.isotonic(s, y)
    assert np.allclose(np.unique(np.round(want, 9)), np.unique(np.round(values, 9)))
    assert np.allclose(model.values, values, atol=0.05) and len(model.steps) == len(steps)
    assert np.allclose(model.score(x), np.clip(np.interp(z @ ridge(z, y), steps, values), 0, 1), atol=0.1)
