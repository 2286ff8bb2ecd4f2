"""The change log: an append-only Parquet table of records, by index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import fold

#: A record as written; null means not set.
RECORD_SCHEMA = (
    "timestamp_ms long, seq long, index_code string, docid string, deleted boolean, ts int, fields map<string,string>,"
    " variables map<int,double>, categories map<string,string>"
)
_KINDS = dict(c.strip().split(" ", 1) for c in RECORD_SCHEMA.split(", "))


def records(changes: DataFrame) -> DataFrame:
    """Changes with all columns of a record, and the time of their arrival."""
    known = {c: F.col(c).cast(k) if c in changes.columns else F.lit(None).cast(k) for c, k in _KINDS.items()}
    known["timestamp_ms"] = F.unix_millis(F.current_timestamp())
    known["deleted"] = F.coalesce(known["deleted"], F.lit(False))
    return changes.select(*[c.alias(n) for n, c in known.items()])


def append(changes: DataFrame, path: str) -> None:
    """Adds a batch; a record without an index is an error of its sender."""
    checked = records(changes)
    index = F.when(F.col("index_code").isNull(), F.raise_error(F.lit("a record needs an index_code"))).otherwise(F.col("index_code"))
    checked.withColumn("index_code", index).write.mode("append").partitionBy("index_code").parquet(path)


def read(spark: SparkSession, path: str, index_code: str | None = None) -> DataFrame:
    rows = spark.read.schema(RECORD_SCHEMA).parquet(path)
    return rows if index_code is None else rows.where(F.col("index_code") == index_code)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def demultiplex(changes: DataFrame, path: str) -> None:
    """Records of many indexes into one folder per index; the rows of a large index go to many files."""
    records(changes).where("index_code is not null").repartition("index_code", F.pmod(F.xxhash64("docid"), F.lit(16))).write.mode(
        "append"
    ).partitionBy("index_code").parquet(path)


def log_info(log: DataFrame) -> DataFrame:
    """(index_code, records, documents, last): what the log holds."""
    per_doc = log.groupBy("index_code", "docid").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    return per_doc.groupBy("index_code").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("documents"), F.max("last").alias("last"))


def indexes(spark: SparkSession, path: str) -> DataFrame:
    """(index_code, files, bytes) of a log that is laid out by index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    code = F.regexp_extract("path", r"/index_code=([^/]*)/", 1)
    return files.groupBy(F.url_decode(code).alias("index_code")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def delete(spark: SparkSession, path: str, index_code: str) -> bool:
    """Deletes one index's folder; whether there was one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/index_code={index_code}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def compacted(log: DataFrame) -> DataFrame:
    """The log's records folded to one for each document and index: the state that they give, with deletes left out."""
    parts = log.where("index_code is not null").select("*", F.concat_ws("\u0000", "index_code", "docid").alias("_id"))
    state = fold(parts.drop("docid").withColumnRenamed("_id", "docid")).where("not deleted")
    split = F.split("docid", "\u0000", 2)
    return records(state.select("seq", split[0].alias("index_code"), split[1].alias("docid"), "deleted", "ts", "fields", "variables", "categories"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes the folded log to a new folder; readers change to it when it is whole."""
    out = compacted(read(spark, path).withColumn("index_code", F.col("index_code").cast("string")))
    out.repartition("index_code", F.pmod(F.xxhash64("docid"), F.lit(16))).write.partitionBy("index_code").parquet(target)
