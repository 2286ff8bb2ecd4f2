"""Quality classifier: ridge on random Fourier features, then isotonic calibration.

Each document becomes a few statistics of its characters, words and lines. A fixed
draw of random frequencies turns them into features whose inner products approximate
a Gaussian kernel; each partition of the training rows sums its part of the normal
equations, and the ridge solution scores all rows. Pool-adjacent-violators on the
training scores of other folds turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise, slices

#: Bytes counted together, as shares of the text.
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!", b"?", b"*", b"#",
    b"$%", b"&", b"|", b"<>{}[]()", b"\"'`", b"@/\\_=+~^-",
]
N_STATISTICS = len(CLASSES) + 9
#: Most training rows, about (a share of the labelled rows is drawn by hash), and parts that sum them.
TRAINING_ROWS, PARTS = 100_000, 16


def statistics(text: str | None) -> list[float]:
    """Of the whole text; all zero if null or empty."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    out = [counts[np.frombuffer(c, np.uint8)].sum() / n for c in CLASSES]
    words, lines = raw.split(), raw.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    m = max(1, len(words))
    return [
        *out, counts[128:].sum() / n, np.log1p(n), np.log1p(len(words)), float(sizes.mean()) if len(words) else 0.0,
        float(sizes.std()) if len(words) else 0.0, len(set(words)) / m, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(w.isupper() for w in words) / m,
    ]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # isotonic: raw scores, ascending, and their values
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequencies + self.phase), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.steps, self.values), 0, 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean score and mean label of each pool, both ascending."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # labels, scores, rows
    for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        pools.append([y, s, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            y, s, n = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + s, pools[-1][2] + n]
    p = np.array(pools)
    return p[:, 1] / p[:, 2], p[:, 0] / p[:, 2]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, x: the statistics of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, x array<double>")


def fit(training: DataFrame, features: int = 256, ridge: float = 1e-3, width: float = 3.0, seed: int = 42) -> Model | None:
    """``training``: x, y (0 or 1), part (0 to PARTS - 1). None if it is empty.

    Two passes over the parts: moments of the statistics, then the normal equations. The
    driver gets a matrix of fixed size per part, and the scores of the bounded training
    rows for the calibration, each from the weights of the other half of the parts.
    """
    parts = training.repartition(PARTS, "part")
    d, k = N_STATISTICS, features + 1

    def sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((sums(_matrix(b.column(0))) for b in batches if len(b)), np.zeros(1 + 2 * d))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    n, *rest = sum((np.array(r.v) for r in parts.select("x").mapInArrow(moments, "v array<double>").collect()), np.zeros(1 + 2 * d))
    if not n:
        return None
    mean, square = np.split(np.array(rest) / n, 2)
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    spread[spread < 1e-9] = 1
    draw = np.random.default_rng(seed)
    model = Model(mean, spread, draw.normal(0, 1 / width, (d, features)) / np.sqrt(d) * np.sqrt(4), draw.uniform(0, 2 * np.pi, features), np.zeros(k), np.zeros(0), np.zeros(0))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k, k + 1))
        for b in batches:
            for half in (0, 1):
                own = b.column(2).to_numpy() % 2 == half
                z = model.features(_matrix(b.column(0))[own])
                total[half] += z.T @ np.hstack([z, b.column(1).to_numpy()[own, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

    halves = sum(np.array(r.v).reshape(2, k, k + 1) for r in parts.select("x", "y", "part").mapInArrow(equations, "v array<double>").toLocalIterator())

    def solve(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:, :k] + ridge * max(1.0, m[-1, k - 1]) * np.eye(k) / k, m[:, k])

    crossed = [solve(halves[1]), solve(halves[0])]
    model.weights = solve(halves[0] + halves[1])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, half = model.features(_matrix(b.column(0))), b.column(2).to_numpy() % 2
            s = np.where(half == 0, z @ crossed[0], z @ crossed[1])
            yield pa.RecordBatch.from_arrays([pa.array(s), b.column(1)], names=["s", "y"])

    pairs = np.array([(r.s, r.y) for r in parts.select("x", "y", "part").mapInArrow(held, "s double, y double").toLocalIterator()])
    model.steps, model.values = isotonic(pairs[:, 0], pairs[:, 1])
    return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    threshold: float = 0.3,
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score (0 to 1), predicted.

    Rows whose crc32(id as text) mod ``folds`` is 0 are held out of the training; others
    with a label 0 or 1 are trained on, about ``training_rows`` of them at most, drawn by
    a hash of the id. Only the text makes a score. Null and empty texts have all
    statistics zero and get the score of that point; null ids count as held out. Without
    any training row all scores are 0.5. Repeated rows are scored each; an empty table
    gives an empty result; other columns are not read.
    """
    stats = materialise(with_statistics(docs, id_col, text_col), "statistics")
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marks = marks.where(F.crc32(F.col(id_col).cast("string")) % folds != 0).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    n = marks.count()
    # a share of the labelled ids, so that about training_rows remain; all, if there are fewer
    share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, training_rows / max(1, n)))
    training = stats.join(marks.where(share), "id").select("x", "y", F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part"))
    model = fit(materialise(training, "training"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1)) if len(b) else np.zeros((0, N_STATISTICS))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stats.select("id", "x").mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % folds == 0, F.lit(True)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
