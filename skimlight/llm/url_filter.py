"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path
starts with the rule's path; the longest fitting rule wins. A URL therefore asks
for the keys ``suffix of its host + prefix of its path``, with prefixes of the
lengths that rules have. Each key probes one 64-bit block of the filter; only
possible hits go into the hash join on the key itself, which removes the false
positives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import materialise

#: Bits set per key, all in one 64-bit block, and bits of the filter per key.
BITS, BITS_PER_KEY = 4, 16
#: Most blocks of a filter (8 MB). Beyond it more keys pass; the join stays exact.
MOST_BLOCKS = 1 << 20

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    c = F.col(url) if isinstance(url, str) else url
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(c, F.lit("")), _PARTS, 1), upper, lower)


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(c, F.lit("")), _PARTS, 2)


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bit mask of each hash."""
    h = np.asarray(h, np.int64).view(np.uint64)
    mask = np.zeros(len(h), np.uint64)
    for i in range(BITS):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), mask


def build_filter(keys: DataFrame) -> np.ndarray:
    """Blocks of 64 bits for the column ``key``; the executors OR the masks, the driver gets the blocks."""
    n = keys.count()
    blocks = 1
    while blocks < min(MOST_BLOCKS, -(-n * BITS_PER_KEY // 64)):
        blocks *= 2

    @F.pandas_udf("struct<block: long, mask: long>")
    def place(h: pd.Series) -> pd.DataFrame:
        block, mask = _bits(h.to_numpy(), blocks)
        return pd.DataFrame({"block": block, "mask": mask.view(np.int64)})

    placed = keys.select(place(F.xxhash64("key")).alias("p")).select("p.*")
    words = np.zeros(blocks, np.uint64)
    for row in placed.groupBy("block").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        words[row.block] = np.array([row.mask], np.int64).view(np.uint64)[0]
    return words


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict.

    ``rules``: host, path, verdict ('allow' or 'block'); rules with a null in any of
    them are left out. Of fitting rules the longest (host and path together) wins, of
    these the one with the longer host, of equal rules 'block'. Without a fitting rule
    ``rule`` is null and the verdict ``default``. Null URLs, and those without ``://``,
    have empty host and path and fit no rule. Rows that repeat an id are judged each;
    URLs of any length are read whole. The filter grows with the rules up to MOST_BLOCKS
    blocks; with more rules more keys pass it, and the join stays exact. Pages without a
    possible hit are never shuffled. Empty tables give empty results; other columns are not read.
    """
    spark = pages.sparkSession
    listed = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat_ws("\n", F.lower("host"), "path").alias("key"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("best"),
    )
    listed = listed.groupBy("key").agg(F.max("best").alias("best"))
    # distinct lengths of rule paths: no more than a URL is long
    sizes = sorted(r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect())
    words = build_filter(listed.select("key"))
    blocks = len(words)

    @F.pandas_udf("array<boolean>")
    def possible(hashes: pd.Series) -> pd.Series:
        ends = np.cumsum(hashes.map(len).to_numpy(np.int64)) if len(hashes) else np.zeros(0, np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *hashes])
        block, mask = _bits(flat, blocks)
        return pd.Series(np.split((words[block] & mask) == mask, ends[:-1]) if len(hashes) else [])

    rows = pages.select(
        F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"),
        F.monotonically_increasing_id().alias("row"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\n", s, p))))
    asked = (
        rows.withColumn("keys", keys)
        .withColumn("maybe", possible(F.transform("keys", lambda k: F.xxhash64(k))))
        .withColumn("keys", F.filter("keys", lambda k, i: F.get("maybe", i)))
        .select("row", "id", "host", "path", "keys")
    )
    asked = materialise(asked, "asked")
    hits = (
        asked.where("size(keys) > 0").select("row", "id", "host", "path", F.explode("keys").alias("key"))
        .join(listed, "key", "left").groupBy("row", "id", "host", "path").agg(F.max("best").alias("best"))
    )
    others = asked.where("size(keys) = 0").select("row", "id", "host", "path", F.lit(None).cast(hits.schema["best"].dataType).alias("best"))
    return hits.unionByName(others).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
