"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every row is reduced to its digests, its identifier and its number. Rows are dealt
over ``fanout ** levels`` runs; a run is sorted by digest and holds one entry per
digest, with the smallest identifier, the count, and the run. Then runs exchange
pieces in binomial rounds: in a round, runs whose numbers differ in one digit (to
the base ``fanout``) cut their digests into as many ranges, each takes one range
from all of them, and merges the sorted pieces, keeping the smallest identifier of
equal digests. After ``levels`` rounds each run holds one range of all digests.

A text that makes up a third of all rows is one entry in each run from the start,
so no task ever holds a group of copies. An entry remembers the runs it came from
(at most as many as there are); with these the result goes straight back to them.

Entries are equal only if SHA-256, MD5 and the length in code points all agree:
that is the verification at each level; texts themselves never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import SPACE, materialise

KEY = ["sha", "md5", "chars"]
#: Bits of a digest that place it in a range.
RANGE_BITS = 28


def normalised(text: str | Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def runs_for(spark, fanout: int) -> int:
    """Rounds of the tree: enough runs for four per shuffle partition, two rounds at least."""
    want, levels = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2
    while fanout**levels < want:
        levels += 1
    return levels


def sorted_run(entries: DataFrame, *aggregates: Column) -> DataFrame:
    """Entries brought to their runs, sorted there by digest, and those of one digest merged."""
    return entries.repartition("run").sortWithinPartitions("run", *KEY).groupBy("run", *KEY).agg(*aggregates)


def merge_round(entries: DataFrame, level: int, fanout: int) -> DataFrame:
    """Exchange and merge among the runs whose numbers differ in digit ``level - 1`` only.

    entries: run, KEY, low, n, runs. The upper digits of a run's number stay, the lower
    ``level`` digits become the number of the digest's range.
    """
    width = fanout**level
    top = F.conv(F.substring(F.hex("sha"), 1, RANGE_BITS // 4), 16, 10).cast("long")
    place = F.floor(F.col("run") / width) * width + F.shiftright(top * width, RANGE_BITS)
    return sorted_run(
        entries.withColumn("run", place), F.min("low").alias("low"), F.sum("n").alias("n"), F.flatten(F.collect_list("runs")).alias("runs")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fanout: int = 16, levels: int | None = None
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of ASCII white space becomes one
    space; null counts as empty. The row with the smallest identifier stays. Null
    identifiers are larger than all others; of rows that repeat an identifier and
    text exactly one stays. Texts are read whole, however long. An empty table gives
    an empty result. Other columns are not read, whatever their names.
    """
    levels = levels or runs_for(docs.sparkSession, fanout)
    text = normalised(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.unhex(F.md5(text)).alias("md5"),
        F.length(text).alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    # stored, so that a row's number and run are the same whenever they are read
    rows = materialise(rows, "digests").withColumn("run", F.pmod(F.xxhash64("row"), F.lit(fanout**levels)))
    smallest = F.struct(F.col("id").isNull().alias("without"), "id", "row")
    entries = sorted_run(rows, F.min(smallest).alias("low"), F.count(F.lit(1)).alias("n")).withColumn("runs", F.array("run"))
    for level in range(1, levels + 1):
        entries = merge_round(entries, level, fanout)
    found = entries.select(*KEY, "low", "n", F.explode("runs").alias("run"))
    return rows.join(found, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        F.col("low.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("low.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
