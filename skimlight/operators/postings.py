"""The inverted index as a DataFrame, and what is counted from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer, analyzers

ASCII = r"^[\x00-\x7F]*$"
#: Terms that an autocompletion offers.
BEST = 5


def long_fields(documents: DataFrame) -> DataFrame:
    """(docid, fields map) -> (docid, field, text); the id itself is a field too."""
    return documents.select("docid", F.explode(F.map_concat("fields", F.create_map(F.lit("documentId"), "docid"))).alias("field", "text"))


def _analysed(texts: DataFrame, analyze: Callable[[str], Analyzer], fields: list[str] | None = None) -> DataFrame:
    """(docid, field, text) -> (docid, field, t): the terms of each text with their positions, in one array."""
    terms = analyze("")(F.col("text"))
    for name in fields or []:
        terms = F.when(F.col("field") == name, analyze(name)(F.col("text"))).otherwise(terms)
    terms = F.when(F.col("field") == "documentId", F.array(F.struct(F.lit(1).alias("pos"), F.col("text").alias("term")))).otherwise(terms)
    return texts.where("text is not null").select("docid", "field", terms.alias("t"))


def tokens(
    texts: DataFrame, analyze: Callable[[str], Analyzer], fields: list[str] | None = None, wanted: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(docid, field, text) -> (docid, field, doc_len, pos, term).

    ``fields`` names those with analyzers of their own. ``wanted`` tells of a term whether
    it is asked for; others are dropped before they become rows (doc_len counts all).
    """
    kept = F.col("t") if wanted is None else F.filter("t", lambda t: wanted(t["term"]))
    each = _analysed(texts, analyze, fields).select("docid", "field", F.size("t").alias("doc_len"), F.explode(kept).alias("t"))
    return each.select("docid", "field", "doc_len", "t.pos", "t.term")


def postings_of_texts(
    texts: DataFrame, analyze: Callable[[str], Analyzer] | None = None, fields: list[str] | None = None,
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(docid, field, text) -> postings of each text (field, term, docid, positions, tf, doc_len), without a shuffle.

    The terms of a text are sorted within their array, and cut where the term changes:
    rows are postings from the start, and nothing has to be gathered from rows of tokens.
    """
    kept = F.col("t") if wanted is None else F.filter("t", lambda t: wanted(t["term"]))
    ordered = F.sort_array(F.transform(kept, lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos"))))
    rows = _analysed(texts, analyze or analyzers(), fields).select("docid", "field", F.size("t").alias("doc_len"), ordered.alias("s"))
    places = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)))
    begins = F.filter(places, lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"]))
    rows = rows.withColumn("begins", begins)

    def posting(begin: Column, i: Column) -> Column:
        end = F.coalesce(F.get("begins", i + 1), F.size("s"))
        return F.struct(F.get("s", begin)["term"].alias("term"), F.array_distinct(F.slice("s", begin + 1, end - begin)["pos"]).alias("positions"))

    # the outer form, as Spark would else evaluate the array a second time to leave out empty ones; a text without terms has one null
    each = rows.select("docid", "field", "doc_len", F.explode_outer(F.transform("begins", posting)).alias("p")).where("p.term is not null")
    return each.select("field", "p.term", "docid", "p.positions", F.size("p.positions").alias("tf"), "doc_len")


def build_postings(
    texts: DataFrame, analyze: Callable[[str], Analyzer] | None = None, fields: list[str] | None = None,
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The same where texts of one document and field may be in several rows: their positions are united, the longest counts."""
    rows = postings_of_texts(texts, analyze, fields, wanted)
    grouped = rows.groupBy("field", "term", "docid").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"), F.max("doc_len").alias("doc_len")
    )
    return grouped.select("field", "term", "docid", "positions", F.size("positions").alias("tf"), "doc_len")


def field_of(df: DataFrame, docid: str, text: str, field: str = "text") -> DataFrame:
    """A table with one text column as (docid, field, text)."""
    return df.select(F.col(docid).alias("docid"), F.lit(field).alias("field"), F.col(text).alias("text"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df, cnt): documents with the term and its occurrences."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cnt"))


def popularity(stats: DataFrame) -> DataFrame:
    """(field, term, cnt) of ASCII terms, for suggestions."""
    return stats.where(F.col("term").rlike(ASCII)).select("field", "term", "cnt")


def popularity_from(texts: DataFrame, analyze: Callable[[str], Analyzer] | None = None) -> DataFrame:
    """``popularity`` straight from (docid, field, text), also of a stream."""
    rows = tokens(texts, analyze or analyzers())
    return rows.where(F.col("term").rlike(ASCII)).groupBy("field", "term").agg(F.count(F.lit(1)).alias("cnt"))


def engine_stats(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents, terms, postings, tokens."""
    docs = documents.agg(F.count(F.lit(1)).alias("documents"))
    # terms first, so that none is counted in a single task's set
    terms = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("t"))
    return docs.join(terms.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tokens")))
