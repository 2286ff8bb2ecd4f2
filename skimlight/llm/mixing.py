"""Mixing sources to target weights (DataFrame functions only).

Weights go down a tree domain > language > source. At each node the budget is
shared among its children in proportion to their weights; a child that has less
than its share gives all it has, and what it lacks goes to its siblings. As a
node never gets more than its leaves hold, a shortage is settled among siblings
first and reaches the node's own siblings only if the whole subtree is short.

A leaf's quota is met from seeded epochs: each epoch is an order of the leaf's
documents by a hash of (seed, epoch, doc_id). Whole epochs are taken while they
fit, then the longest prefix of the next one that stays within the quota. Prefix
sums are taken over 256 hash buckets of a leaf, then over 256 smaller ones in each,
then over the rows of one small bucket, so a source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import materialise, prefix_sums, stored_bytes

LEVELS = ["domain", "lang", "source"]
#: Quotas up to this size on disk are broadcast; beyond it, rows are dealt by leaf and salt.
BROADCAST_BYTES, SALTS = 4 << 20, 64


def tokens_of(text: str | Column) -> Column:
    """Words between ASCII white space; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weight_of(column: str, weights: Mapping[str, int], other: int) -> Column:
    c = F.lit(other)
    for name, w in weights.items():
        c = F.when(F.col(column) == name, w).otherwise(c)
    return c.cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds quota: each parent's ``budget`` among its children by ``weight``, at most ``supply`` each.

    Whole numbers throughout: children are taken in the order supply / weight; one
    whose supply is within its share of what is left gets all of it, the others get
    the rounded-down shares of the rest. Products of tokens and weights are decimals of
    38 digits, so none overflows; the order compares whole quotients, then remainders
    (exact for weights below 2^26), then names. A parent without children has no rows; supplies are not null.
    """
    quotient = [F.expr("supply div weight"), (F.col("supply") % F.col("weight")) / F.col("weight"), F.col(child)]
    order = Window.partitionBy(*parent).orderBy(*quotient)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    left = children.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0))).alias("money"),
        F.sum("weight").over(after).alias("rest"),
    ).withColumn("full", wide("supply") * wide("rest") <= wide("weight") * wide("money"))
    short = F.when(~F.col("full"), F.struct(F.col("money"), F.col("rest")))
    # money / rest falls short at the first child that is not full; that one sets the price
    return (
        left.withColumn("price", F.max(short).over(whole))
        .withColumn(
            "quota",
            F.when(F.col("full"), F.col("supply")).otherwise(
                F.expr("cast((cast(weight as decimal(19,0)) * cast(price.money as decimal(19,0))) div price.rest as long)")
            ),
        )
        .drop("money", "rest", "full", "price")
    )


def leaf_quotas(
    supply: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], other: Mapping[str, int], epochs: int
) -> DataFrame:
    """domain, lang, source, tokens, quota for the leaf table ``supply`` (domain, lang, source, tokens).

    ``budget``: at most what the leaves hold in all epochs. Weights of zero or less give no quota.
    """
    leaves = supply.withColumn("supply", F.col("tokens") * epochs)
    for name in LEVELS:
        leaves = leaves.where(weight_of(name, weights.get(name, {}), other.get(name, 1)) > 0)
    above, quota = [], None
    for name in LEVELS:
        kids = leaves.groupBy(*above, name).agg(F.sum("supply").alias("supply"))
        kids = kids.withColumn("weight", weight_of(name, weights.get(name, {}), other.get(name, 1)))
        kids = kids.withColumn("budget", F.lit(budget).cast("long")) if quota is None else kids.join(quota, above)
        shared = share_out(kids, above, name)
        above = [*above, name]
        quota = shared.select(*above, F.col("quota").alias("budget"))
    return leaves.select(*LEVELS, "tokens").join(quota.withColumnRenamed("budget", "quota"), LEVELS)


def mix_sources(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    other: Mapping[str, int] | None = None,
    budget_permille: int = 500,
    budget_tokens: int | None = None,
    epochs: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    unchosen: bool = False,
) -> DataFrame:
    """One row per chosen row of ``docs``: ``id_col``, domain, lang, source, tokens, times.

    With ``unchosen`` there is one for each row, with times 0 for those not chosen.

    ``weights``: whole-number weights by level (domain, lang, source) and name;
    ``other``: those of unnamed nodes (1). The budget is ``budget_tokens``, or
    ``budget_permille`` of all tokens. ``times``: in how many epochs the row is taken,
    at most ``epochs``. Null domain, language or source count as the empty name; null
    or blank texts have no tokens and are taken with the prefix they fall in. Rows with a null
    identifier are ordered by a hash of their texts. Repeated rows are rows of their own. Texts
    are counted whole. An empty table gives an empty result. Only the named columns are read.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"), F.coalesce(domain, F.lit("")).alias("domain"),
            F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"),
            tokens_of(text_col).alias("tokens"),
            # rows without an identifier are told apart by their texts
            F.when(F.col(id_col).isNull(), F.md5(F.coalesce(text_col, F.lit("")))).alias("unnamed"),
        ),
        "tokens",
    )
    supply = materialise(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "supply")
    usable = supply
    for name in LEVELS:
        usable = usable.where(weight_of(name, weights.get(name, {}), (other or {}).get(name, 1)) > 0)
    total = usable.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    budget = min(total * budget_permille // 1000 if budget_tokens is None else budget_tokens, total * epochs)
    leaves = leaf_quotas(supply, budget, weights, other or {}, epochs).select(
        *LEVELS,
        F.expr("case when tokens > 0 then quota div tokens else 0L end").alias("whole"),
        F.expr("case when tokens > 0 then quota % tokens else 0L end").alias("left"),
    )
    leaves = materialise(leaves, "quotas")
    if stored_bytes(docs.sparkSession, leaves) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(leaves), LEVELS, "left")
    else:  # the rows of a large leaf go to many tasks, each with a copy of its quota
        salted = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("id", "tokens"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, [*LEVELS, "salt"], "left").drop("salt")
    if not unchosen:
        joined = joined.where("whole is not null")
    joined = joined.withColumns({"whole": F.coalesce("whole", F.lit(0)), "left": F.coalesce("left", F.lit(0))})
    order = F.md5(F.concat_ws(":", F.lit(seed), "whole", F.col("id").cast("string"), "unnamed"))
    placed = prefix_sums(joined.withColumn("place", order), LEVELS, "place", "tokens", ["id", "tokens"])
    return (
        placed.withColumn("times", F.expr("if(whole + left > 0, whole + if(upto <= left, 1L, 0L), 0L)"))
        .where(F.lit(unchosen) | (F.col("times") > 0))
        .select(F.col("id").alias(id_col), *LEVELS, "tokens", "times")
    )
