"""Documents from JSON or from tables, and search results as JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_SCHEMA = "docid string, fields map<string,string>, variables map<string,double>, categories map<string,string>"

#: Spark makes no smaller splits of files than this.
SPLIT_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals a table over all cores if its files are too small to be split among them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 64 << 10 < size < cores * SPLIT_BYTES else df


def valid(documents: DataFrame) -> DataFrame:
    """Without rows that have no id."""
    return documents.where("docid is not null and docid <> ''")


def read_json(spark: SparkSession, path: str, now: int, multiline: bool = True) -> DataFrame:
    """Objects or arrays of {docid, fields, variables, categories} as additions; a field ``timestamp`` is kept, else ``now``."""
    raw = spark.read.schema(JSON_SCHEMA).option("multiLine", multiline).json(path)
    return additions(raw, now)


def parse_json(lines: DataFrame, now: int, column: str = "value") -> DataFrame:
    """The same from a column of strings, each one object; also of a stream."""
    return additions(lines.select(F.from_json(column, JSON_SCHEMA).alias("d")).select("d.*"), now)


def additions(raw: DataFrame, now: int) -> DataFrame:
    stamp = F.coalesce(F.try_element_at("fields", F.lit("timestamp")).try_cast("int"), F.lit(now)).alias("ts")
    variables = F.transform_keys("variables", lambda k, v: k.cast("int")).alias("variables")
    return valid(raw).select("docid", F.lit(False).alias("deleted"), stamp, "fields", variables, "categories")


def deletions(docids: DataFrame, column: str = "docid") -> DataFrame:
    rows = docids.select(F.col(column).cast("string").alias("docid"), F.lit(True).alias("deleted"))
    return valid(rows)


def from_table(
    df: DataFrame, docid: str, fields: Mapping[str, Column | str], variables: Sequence[Column | str] = (), categories: Mapping[str, Column | str] | None = None,
    ts: Column | str | int = 0,
) -> DataFrame:
    """A table's columns as additions: fields and categories by name, variables by number."""

    def column(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    def named(columns: Mapping[str, Column | str], kind: str) -> Column:
        pairs = [x for k, c in columns.items() for x in (F.lit(k), column(c).cast(kind))]
        whole = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
        return F.map_filter(whole, lambda k, v: v.isNotNull())

    values = [x for i, c in enumerate(variables) for x in (F.lit(i), column(c).cast("double"))]
    numbers = F.create_map(*values) if values else F.lit(None).cast("map<int,double>")
    stamp = F.lit(ts) if isinstance(ts, int) else column(ts)
    return df.select(
        F.col(docid).cast("string").alias("docid"), F.lit(False).alias("deleted"), stamp.cast("int").alias("ts"),
        named(fields, "string").alias("fields"), numbers.alias("variables"), named(categories or {}, "string").alias("categories"),
    )


def statuses(lines: DataFrame, column: str = "value") -> DataFrame:
    """(item, added, error) for each line, in the order of the lines' numbers: whether it is a document."""
    d = F.from_json(column, JSON_SCHEMA)
    good = F.coalesce(d["docid"].isNotNull() & (d["docid"] != "") & d["fields"].isNotNull(), F.lit(False))
    return lines.select(F.col(column).alias("item"), good.alias("added"), F.when(~good, "Invalid or missing argument").alias("error"))


def flat(rows: DataFrame) -> DataFrame:
    """Result rows with one map column ``result``: docid, query_relevance_score, fields and snippets by name, variable_0 ..., category_...; all as text."""
    parts = [F.create_map(F.lit("docid"), "docid", F.lit("query_relevance_score"), F.col("score").cast("string"))]
    if "fields" in rows.columns:
        parts.append(F.coalesce("fields", F.create_map().cast("map<string,string>")))
    if "vars" in rows.columns:
        numbered = F.transform("vars", lambda v, i: F.struct(F.concat(F.lit("variable_"), i), v.cast("string")))
        parts.append(F.map_from_entries(numbered))
    if "cats" in rows.columns:
        parts.append(F.coalesce(F.transform_keys("cats", lambda k, v: F.concat(F.lit("category_"), k)), F.create_map().cast("map<string,string>")))
    shown = [c for c in rows.columns if c.startswith("snippet_")]
    if shown:
        parts.append(F.create_map(*[x for c in shown for x in (F.lit(c), F.col(f"`{c}`"))]))
    # a stored field may be named like a key of the result, which then wins
    entries = F.flatten(F.array(*[F.map_entries(p) for p in [*parts[1:], parts[0]]]))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"].alias("value")))
    return rows.select("docid", "score", F.map_from_entries(last).alias("result"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object per result row, in the column ``value``, with the flat keys of ``flat``."""
    return flat(rows).orderBy(F.col("score").desc(), "docid").select(F.to_json("result").alias("value"))


def completions_json(partial: str, found: Sequence[str]) -> str:
    """The answer to an autocompletion."""
    return json.dumps({"query": partial, "suggestions": list(found)}, ensure_ascii=False)
