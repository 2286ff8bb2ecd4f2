"""Exact top-k inner-product search by no-random-access aggregation.

Each dimension is a sorted list of a block's candidates, read from its top for
queries that are positive there and from its bottom for the others. What has been
read gives every candidate a lower bound (the list's worst value where it was not
met) and an upper bound (the value read last there). Reading goes deeper until few
candidates can still reach the k-th best score known, by these bounds or from
earlier blocks; only those are then scored in full. A block none of whose lists
begins high enough is left without a look at its candidates; blocks follow one
another from long vectors to short ones, so on skewed data most are left.

Queries and candidates meet block by block: a task gets one slice of the
candidates and one group of the queries, both of bounded size, and returns the k
best of its slice for each query; the slices' lists are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import materialise

#: Candidates of a slice and queries of a group: what a task holds at most, about.
SLICE_ROWS, GROUP_ROWS = 6144, 4096
#: Candidates of a block (of one set of lists), and queries that read it at once.
BLOCK_ROWS, BLOCK_QUERIES = 1024, 512
#: Lists are read to this part of their length, then twice as far; until so many of the pairs are left.
FIRST_PART, FEW = 8, 0.05

LONG = 2**63 - 1


class Lists:
    """Sorted lists of a block of candidates, one for each dimension."""

    def __init__(self, x: np.ndarray):
        self.x, self.sorted = x, np.sort(x, axis=0)
        self.low, self.high = self.sorted[0], self.sorted[-1]
        # Cauchy-Schwarz, rounded up
        self.length = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())) * (1 + 1e-9)

    def most(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """What no candidate of the block exceeds, before anything is read."""
        by_length = np.sqrt(((up + down).astype(np.float64) ** 2).sum(axis=1)) * self.length * (1 + 1e-9)
        return np.minimum(up @ self.high + down @ self.low, by_length)

    def bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x candidates) after ``depth`` entries of each list.

        up and down: the queries' positive and negative components, zero elsewhere. Only
        entries at or beyond the last one read are looked at.
        """
        top, bottom = self.sorted[len(self.x) - depth], self.sorted[depth - 1]
        upper = up @ np.maximum(self.x, top).T + down @ np.minimum(self.x, bottom).T
        lower = up @ np.where(self.x >= top, self.x, self.low).T + down @ np.where(self.x <= bottom, self.x, self.high).T
        return lower, upper


def candidates_of(lists: Lists, q: np.ndarray, own: np.ndarray, need: np.ndarray, k: int, slack: float = 0) -> np.ndarray:
    """Which (query, candidate) can be among the k best of the block and reach ``need``.

    own: pairs that take no part; need: a lower bound per query on the score that counts;
    slack: how far a bound may be from its true value by rounding. True for all that qualify, and for few others.
    """
    n = len(lists.x)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    may = np.zeros((len(q), n), bool)
    asks = np.flatnonzero(lists.most(up, down) + slack >= need)
    depth = max(1, n // FIRST_PART)
    while len(asks):
        depth = min(n, depth)
        lower, upper = lists.bounds(up[asks], down[asks], depth)
        lower[own[asks]] = -np.inf
        if n > k:
            need[asks] = np.maximum(need[asks], np.partition(lower, n - k, axis=1)[:, n - k] - slack)
        may[asks] = (upper + slack >= need[asks, None]) & ~own[asks]
        left = may[asks].sum(axis=1)
        asks = asks[left > max(k, FEW * n)] if depth < n else asks[:0]
        depth *= 2
    return may


def search_slice(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Position of the query, candidate id and score of the k best candidates of each query, and the share of pairs scored in full.

    q and x hold whole numbers as float64. Products are summed in the narrowest type that
    is exact for their range; beyond doubles the bounds allow for rounding and the scores are whole numbers.
    """
    width = max(1, q.shape[1])
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width
    kind = np.float32 if most < 2**24 else np.float64
    slack = 0.0 if most < 2**53 else most * width * 2**-50
    order = np.argsort(-(x**2).sum(axis=1), kind="stable")
    q, x, x_rows, x_ids = q.astype(kind), x[order].astype(kind), x_rows[order], x_ids[order]
    blocks = [(Lists(x[at : at + BLOCK_ROWS]), at) for at in range(0, len(x), BLOCK_ROWS)]

    def scores(qs: np.ndarray, at: np.ndarray) -> np.ndarray:
        if slack:
            return np.array([sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(qs, x[at], strict=True)], object)
        return np.einsum("ij,ij->i", qs, x[at])

    out, scored = [], 0
    for lo in range(0, len(q), BLOCK_QUERIES):
        own, own_rows = q[lo : lo + BLOCK_QUERIES], q_rows[lo : lo + BLOCK_QUERIES]
        best: list[list] = [[] for _ in own]  # (-score, id)
        need = np.full(len(own), -np.inf)
        for lists, at in blocks:
            same = own_rows[:, None] == x_rows[None, at : at + BLOCK_ROWS]
            row, col = np.nonzero(candidates_of(lists, own, same, need, k, slack))
            scored += len(row)
            col += at
            full = np.concatenate([np.zeros(0, object if slack else kind), *(scores(own[row[i : i + 65536]], col[i : i + 65536]) for i in range(0, len(row), 65536))])
            ends = np.searchsorted(row, np.arange(len(own) + 1))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[i], ends[i + 1]
                best[i] = sorted([*best[i], *zip((-full[a:b]).tolist(), x_ids[col[a:b]].tolist(), strict=True)])[:k]
                if len(best[i]) == k:
                    need[i] = max(need[i], float(-best[i][-1][0]) - slack)
        for i, found in enumerate(best):
            out += [(lo + i, c, min(max(int(-s), -LONG), LONG)) for s, c in found]
    at, ids, score = np.array(out, np.int64).reshape(-1, 3).T
    return at, ids, score, scored / max(1, len(q) * len(x))


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query row.

    Each component x becomes floor(scale * x); scores are inner products of these. A
    row's candidates are all other rows with as many components; ties go to the
    smaller id. Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part. Rows that repeat an id or a vector are rows of
    their own: each is answered, and is a candidate of the others. Scores beyond a long are
    given, and compared, as its limit. Vectors of any width are read whole. Empty tables give an empty result; other columns are not read.
    """
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = good.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.transform(vector_col, lambda v: F.lit(float(scale)) * v.cast("double")).alias("v"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "vectors")  # which also fixes the numbers of the rows
    asked = rows.where("asks").select("row", "id", "v")
    n, m = rows.count(), asked.count()
    slices, groups = -(-n // SLICE_ROWS) or 1, -(-m // GROUP_ROWS) or 1
    candidates = rows.select(
        F.size("v").alias("dims"), F.pmod(F.xxhash64("row"), F.lit(slices)).alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("grp"), "row", "id", "v",
    )
    questions = asked.select(
        F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")).alias("slice"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).alias("grp"), "row", "id", "v",
    )
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(asking: pa.Table, given: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> np.ndarray:
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return np.floor(flat).reshape(t.num_rows, len(flat) // t.num_rows)

        if not asking.num_rows or not given.num_rows:
            return schema.empty_table()
        row, ids = asking.column("row").to_numpy(), asking.column("id").to_numpy()
        at, vec, score, _ = search_slice(matrix(asking), row, matrix(given), given.column("row").to_numpy(), given.column("id").to_numpy(), k)
        return pa.table([pa.array(c, pa.int64()) for c in (row[at], ids[at], vec, score)], schema=schema)

    keys = ["dims", "slice", "grp"]
    found = (
        questions.groupBy(*keys).cogroup(candidates.groupBy(*keys))
        .applyInArrow(search, "query long, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
