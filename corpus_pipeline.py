"""Training-corpus pipeline: raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet in the shared folder and reads again as the next stage's ``docs``. All
stages but the last return the columns of ``documents``, and any others there are.

Ids may repeat or be null (null counts as larger than all others): rows are told apart
by id and a hash of all columns. A stage decides on such keys, and the rows that go
leave by an anti-join on them: a broadcast one while their keys are few bytes, so texts
are not shuffled, else one shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimlight.llm.exact_dedup import exact_dedup
from skimlight.llm.language_id import identify_languages
from skimlight.llm.mixing import mix_sources
from skimlight.llm.packing import pack_documents
from skimlight.llm.queries import WEIGHTS, domain_of
from skimlight.llm.simhash import near_duplicates
from skimlight.llm.util import materialise, stored_bytes, table

#: Per mille of the tokens that the mixing stage aims at.
BUDGET_PERMILLE = 800
#: Keys up to this size on disk are broadcast.
BROADCAST_BYTES = 4 << 20

_KEY = "__row_key"


def _key(docs: DataFrame) -> Column:
    """(without an id, id, hash of all columns), in the order of the ids."""
    columns = [docs[f"`{f.name}`"] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("h"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_KEY, _key(docs))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with or without a partner in ``keys`` (a stored table of id and h)."""
    if stored_bytes(docs.sparkSession, keys) <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    keys = keys.withColumnsRenamed({"id": "__id", "h": "__h"})
    return docs.join(keys, _key(docs)["id"].eqNullSafe(keys["__id"]) & (_key(docs)["h"] == keys["__h"]), how)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not among ``gone`` (a column of keys)."""
    return _joined(docs, materialise(gone.select(f"{_KEY}.id", f"{_KEY}.h"), "gone"), "left_anti")


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row for each of the keys ``repeated``, whose rows are equal in all columns; all other rows."""
    repeated = materialise(repeated.select(f"{_KEY}.id", f"{_KEY}.h").distinct(), "repeated")
    if repeated.isEmpty():
        return docs
    one = _keyed(_joined(docs, repeated, "left_semi")).withColumn("__h", F.col(f"{_KEY}.h")).dropDuplicates(["doc_id", "__h"])
    return _joined(docs, repeated, "left_anti").unionByName(one.drop(_KEY, "__h"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language; fills a null lang with the one found.

    Null, blank and letterless texts go, and all documents if no language could be
    learned. Repeated rows are judged each; ties go to the first language by name; an
    empty table stays empty.
    """
    found = identify_languages(docs, carry=True).where("lang_pred <> 'und'")
    columns = [F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the row with the smallest doc_id stays.

    Null texts count as empty and so as equal. Of rows that share id and normalised text
    the one with the smallest hash of all columns stays, so a rerun keeps the same; of
    rows equal in all columns one stays. An empty table stays empty.
    """
    found = materialise(exact_dedup(_keyed(docs), id_col=_KEY).select(_KEY, F.col(_KEY).eqNullSafe(F.col("keep_id")).alias("stays"), "kept"), "found")
    return _once(_without(docs, found.where("not stays")), found.where("stays and not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are 0.8 alike in five-word shingles, directly or by others, the one with the smallest doc_id stays.

    Texts without words, null among them, are one group; rows equal in all columns count
    as one. Ties of ids go to the smallest hash of all columns. An empty table stays empty.
    """
    groups = materialise(near_duplicates(_keyed(docs), id_col=_KEY, words=5, similarity=0.8).select(_KEY, "component_id"), "groups")
    first = groups.where(F.col(_KEY) == F.col("component_id"))
    repeated = first.groupBy(_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _once(_without(docs, groups.where(F.col(_KEY) != F.col("component_id"))), repeated)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A seeded prefix of each domain, language and source, in the proportions of WEIGHTS.

    Null language and source are the empty name; texts without words cost nothing and
    fall in with their neighbours; rows equal in all columns stay or go together. An
    empty table stays empty.
    """
    keyed = _keyed(docs)
    placed = mix_sources(keyed, domain_of("source"), WEIGHTS, budget_permille=BUDGET_PERMILLE, epochs=1, id_col=_KEY, unchosen=True)
    return _without(docs, placed.groupBy(_KEY).agg(F.max("times").alias("times")).where("times = 0"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place in it.

    Null and empty texts are one end token; repeated rows are packed each; an empty table gives no pieces.
    """
    return pack_documents(docs, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID, SimHash and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
