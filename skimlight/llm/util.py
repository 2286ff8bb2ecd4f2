"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.documents import spread
from ..sources.folders import LOCAL_FOLDER, shared_folder

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"

_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a read and not a
    recomputation, and gives Catalyst the true size of the result. ``release``
    removes what this session has written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables ``materialise`` has written; call when results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    """What a session has not released goes with its process; its results are read by then."""
    with contextlib.suppress(Exception):
        if (session := SparkSession.getActiveSession()) is not None:
            release(session)
    for path in _written:
        if path.startswith(f"{LOCAL_FOLDER}/"):
            shutil.rmtree(path, ignore_errors=True)


def stored_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files behind a table ``materialise`` has returned."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; one too small to be split among the cores is dealt over them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold_of(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n`` (null: null)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string")) % n


def prefix_sums(rows: DataFrame, group: list[str], place: str, value: str, ties: list[str]) -> DataFrame:
    """Adds ``upto``: the sum of ``value`` over the group's rows up to this one, in the order of ``place``.

    ``place`` is an MD5 in hex. Sums are taken over 256 buckets of a group by its first
    two digits, over 256 smaller ones in each, and then over the rows of a small one, so
    that a group with a third of all rows is never sorted in one task. Rows of one place
    follow ``ties``; rows equal in those, too, in any order. Null values count as nothing; an empty table stays empty.
    """
    rows = rows.withColumns({"_b2": F.substring(place, 1, 2), "_b4": F.substring(place, 1, 4)})
    b4 = rows.groupBy(*group, "_b2", "_b4").agg(F.sum(value).alias("_n"))
    b2 = b4.groupBy(*group, "_b2").agg(F.sum("_n").alias("_n"))
    prior = (Window.unboundedPreceding, -1)
    at2 = Window.partitionBy(*group).orderBy("_b2").rowsBetween(*prior)
    at4 = Window.partitionBy(*group, "_b2").orderBy("_b4").rowsBetween(*prior)
    b2 = b2.select(*group, "_b2", F.coalesce(F.sum("_n").over(at2), F.lit(0)).alias("_before2"))
    b4 = b4.select(*group, "_b2", "_b4", F.coalesce(F.sum("_n").over(at4), F.lit(0)).alias("_before4"))
    starts = b4.join(b2, [*group, "_b2"]).select(*group, "_b4", (F.col("_before2") + F.col("_before4")).alias("_before"))
    inside = Window.partitionBy(*group, "_b4").orderBy(place, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.drop("_b2")
        .withColumn("upto", F.sum(value).over(inside))
        .join(starts, [*group, "_b4"])
        .withColumn("upto", F.col("upto") + F.col("_before"))
        .drop("_before", "_b4")
    )


def slices(batch, rows: int = 250, text: int = 1, size: int = 8 << 20):
    """Parts of an Arrow batch of at most ``rows`` rows, and of ``size`` bytes of column ``text`` unless one row is longer.

    So few texts are Python objects at a time, however long they are. What Arrow has
    freed goes back to the system, as a worker outlives its task.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).tolist()
    lo = held = 0
    for i, n in enumerate(lengths):
        if i > lo and (i - lo == rows or held + n > size):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(lengths):
        yield batch.slice(lo)
    pa.default_memory_pool().release_unused()


def worker_state() -> dict:
    """What a Python worker keeps from task to task (loaded models and caches)."""
    import sys
    import types

    return sys.modules.setdefault("_skimlight_worker_state", types.ModuleType("_skimlight_worker_state")).__dict__
