"""Change records from a stream into an index, and counts kept by a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import Analyzer
from ..operators.postings import popularity_from
from ..sources import changelog


def ingest(stream: DataFrame, engine, checkpoint: str, index_code: str | None = None, once: bool = False) -> StreamingQuery:
    """Applies each micro-batch to the engine's index. A batch that is replayed after a failure is skipped."""

    def batch(changes: DataFrame, number: int) -> None:
        own = changes if index_code is None else changes.where(changes.index_code == index_code)
        engine.apply(own, batch=number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def deal(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Splits a log of many indexes into one folder each; the sink is exactly-once."""
    rows = changelog.records(stream).where("index_code is not null")
    writer = rows.writeStream.format("parquet").partitionBy("index_code").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def popularity_stream(texts: DataFrame, analyze: Callable[[str], Analyzer] | None = None) -> DataFrame:
    """Term counts of a stream of (docid, field, text); complete or update mode. They only grow."""
    return popularity_from(texts, analyze)


def open_log(spark: SparkSession, path: str) -> DataFrame:
    return changelog.read_stream(spark, path)
