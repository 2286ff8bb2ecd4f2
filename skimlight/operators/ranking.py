"""Order, pages, promotion, facets and the blending of fresh and old documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def top(scored: DataFrame, start: int = 0, limit: int = 10, key: str = "docid") -> DataFrame:
    """Rows ``start`` to ``start + limit`` by score (NaN first, highest first), ties by id."""
    return scored.orderBy(F.col("score").desc(), key).offset(start).limit(limit)


def promote(scored: DataFrame, docid: str | None, spark: SparkSession) -> DataFrame:
    """The promoted document before all others, whether or not it matches."""
    if docid is None:
        return scored
    first = spark.range(1).select(F.lit(docid).cast(scored.schema["docid"].dataType).alias("docid"), F.lit(1.7976931348623157e308).alias("score"))
    return scored.where(F.col("docid") != docid).unionByName(first, allowMissingColumns=True)


def facet_counts(matches: DataFrame, cats: str = "cats") -> DataFrame:
    """(category, value, cnt) over all rows, from a map column. Absent and empty values do not count."""
    each = matches.select(F.explode(cats).alias("category", "value")).where("value is not null and value <> ''")
    return each.groupBy("category", "value").agg(F.count(F.lit(1)).alias("cnt"))


def facet_counts_of(matches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from columns of their own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in columns])
    each = matches.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null and value <> ''")
    return each.groupBy("category", "value").agg(F.count(F.lit(1)).alias("cnt"))


def blend(old: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "docid") -> DataFrame:
    """Old rows whose id has not changed, and the fresh rows: the freshest version wins, whatever it scores."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def with_dynamic(matches: DataFrame, dynamic: DataFrame, key: str = "docid") -> DataFrame:
    """Adds ts, vars and cats; a document without them has zeros and no categories."""
    return matches.join(dynamic, key, "left").withColumns({"ts": F.coalesce("ts", F.lit(0))})
