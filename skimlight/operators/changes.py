"""The state of documents after a log of changes.

Records of a document apply in the order of ``seq``: fields are replaced whole,
variables and categories are updated key by key, a delete clears all. Last values are
aggregates that combine before the shuffle, so a document with a long history costs no
more than its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a change record holds; nullable columns that are null were not set.
CHANGE_SCHEMA = (
    "seq long, index_code string, docid string, deleted boolean, ts int, fields map<string,string>,"
    " variables map<int,double>, categories map<string,string>"
)


def _last_by_key(changes: DataFrame, column: str, cleared: DataFrame) -> DataFrame:
    """docid -> map of the last value of each key since the last delete."""
    each = changes.where(F.col(column).isNotNull() & ~F.coalesce("deleted", F.lit(False))).select("docid", "seq", F.explode(column).alias("key", "value"))
    last = each.groupBy("docid", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    alive = last.join(cleared, "docid", "left").where("cleared is null or seq > cleared")
    return alive.groupBy("docid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias(column))


def _folded(changes: DataFrame) -> DataFrame:
    """(docid, seq, deleted, cleared, ts, fields): the columns that are replaced whole, and the last delete."""
    gone = F.coalesce("deleted", F.lit(False))
    whole = changes.groupBy("docid").agg(
        F.max("seq").alias("seq"), F.max_by(gone, "seq").alias("deleted"), F.max(F.when(gone, F.col("seq"))).alias("cleared"),
        F.max_by(F.struct("seq", F.col("fields").alias("v")), F.when(F.col("fields").isNotNull() & ~gone, F.col("seq"))).alias("f"),
        F.max_by(F.struct("seq", F.col("ts").alias("v")), F.when(F.col("ts").isNotNull() & ~gone, F.col("seq"))).alias("t"),
    )

    def current(c: str) -> Column:
        return F.when(F.col("cleared").isNull() | (F.col(f"{c}.seq") > F.col("cleared")), F.col(f"{c}.v"))

    return whole.select("docid", "seq", "deleted", "cleared", current("t").alias("ts"), current("f").alias("fields"))


def fold_fields(changes: DataFrame) -> DataFrame:
    """``fold`` without ts, variables and categories: one shuffle, and no join that texts would be sorted for."""
    return _folded(changes).select("docid", "seq", "deleted", "fields")


def fold(changes: DataFrame) -> DataFrame:
    """(docid, seq, deleted, ts, fields, variables, categories): a row per document in the log.

    ``deleted``: the last record is a delete. Columns that were never set since the last
    delete are null. An empty category value removes the category.
    """
    whole = _folded(changes)
    cleared = whole.select("docid", "cleared")
    base = whole.select("docid", "seq", "deleted", "ts", "fields")
    categories = _last_by_key(changes, "categories", cleared)
    categories = categories.withColumn("categories", F.map_filter("categories", lambda k, v: v != ""))
    return base.join(_last_by_key(changes, "variables", cleared), "docid", "left").join(categories, "docid", "left")


def live(state: DataFrame) -> DataFrame:
    """Documents that are there: not deleted, and with fields."""
    return state.where("not deleted and fields is not null")


def as_changes(state: DataFrame, seq: int = -(2**63)) -> DataFrame:
    """A folded state as the records that give it, before all others."""
    return state.select(F.lit(seq).cast("long").alias("seq"), "docid", F.lit(False).alias("deleted"), "ts", "fields", "variables", "categories")


def compact(base: DataFrame, newer: DataFrame) -> DataFrame:
    """Folds newer changes onto a folded base and drops tombstones."""
    state = fold(as_changes(base.where("not deleted")).unionByName(newer, allowMissingColumns=True))
    return state.where("not deleted")


def dynamic_of(state: DataFrame, n_vars: int) -> DataFrame:
    """(docid, ts, vars, cats): variables as float32 in an array, 0 where unset; an index out of range is an error."""
    bad = F.exists(F.map_keys("variables"), lambda k: (k < 0) | (k >= n_vars))
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("variable index out of range"))).otherwise(F.col("variables"))
    values = F.array(*[F.coalesce(F.try_element_at(F.col("_v"), F.lit(i)), F.lit(0.0)).cast("float") for i in range(n_vars)])
    cats = F.coalesce("categories", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return state.where("not deleted").withColumn("_v", checked).select("docid", F.coalesce("ts", F.lit(0)).cast("int").alias("ts"), values.alias("vars"), cats.alias("cats"))
