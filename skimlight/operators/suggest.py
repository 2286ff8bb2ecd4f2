"""Autocompletion and spelling suggestions from term counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import spans
from ..plans.query import Node, Phrase, Term
from .postings import BEST


def complete_terms(popular: DataFrame, field: str, prefix: str, n: int = BEST) -> DataFrame:
    """(term, cnt): the most frequent terms of a field with a prefix, ties in order."""
    found = popular.where((F.col("field") == field) & F.col("term").startswith(prefix))
    return found.select("term", "cnt").orderBy(F.col("cnt").desc(), "term").limit(n)


def best_by_prefix(popular: DataFrame, longest: int, n: int = BEST) -> DataFrame:
    """(field, prefix, term, cnt, rank) for all prefixes up to a length: a table for lookups."""
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(longest))), lambda i: F.substring(F.col("term"), F.lit(1), i))
    best = Window.partitionBy("field", "prefix").orderBy(F.col("cnt").desc(), "term")
    each = popular.where("term <> ''").select("field", "term", "cnt", F.explode(prefixes).alias("prefix"))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def complete(popular: DataFrame, partial: str, field: str = "text") -> list[str]:
    """Completions of the last word, after the words before it."""
    if not (found := spans(partial)):
        return []
    term, start, _ = found[-1]
    return [partial[:start] + r.term for r in complete_terms(popular, field, term).collect()]


def complete_queries(query_terms: DataFrame, partial: str) -> list[str]:
    """Completions of the first word from terms of past queries (term, cnt)."""
    if not (found := spans(partial)):
        return []
    own = query_terms.select(F.lit("").alias("field"), "term", "cnt")
    return [r.term for r in complete_terms(own, "", found[0][0]).collect()]


def neighbours(popular: DataFrame, term: str, distance: int = 1, field: str = "text") -> DataFrame:
    """(term, cnt) within an edit distance; lengths are compared first."""
    near = popular.where((F.col("field") == field) & F.length("term").between(len(term) - distance, len(term) + distance))
    return near.where(F.levenshtein("term", F.lit(term), distance).between(0, distance)).select("term", "cnt")


def correct_terms(popular: DataFrame, terms: list[str], field: str = "text") -> dict[str, str]:
    """Unknown terms of over three letters -> their most frequent neighbour. One pass for all."""
    terms = sorted({t for t in terms if len(t) > 3})
    if not terms:
        return {}
    asked = popular.sparkSession.createDataFrame([(t,) for t in terms], "asked string")
    near = popular.where(F.col("field") == field).join(F.broadcast(asked), F.abs(F.length("term") - F.length("asked")) <= 1)
    near = near.where(F.levenshtein("term", "asked", 1).between(0, 1))
    best = near.groupBy("asked").agg(
        F.bool_or(F.col("term") == F.col("asked")).alias("known"), F.min_by("term", F.struct(-F.col("cnt"), "term")).alias("term")
    )
    return {r.asked: r.term for r in best.collect() if not r.known}


def did_you_mean(popular: DataFrame, query: Node, text: str) -> str | None:
    """The query string with misspelt terms replaced; None if nothing is to be corrected, or not in one place."""
    terms = [t for n in query.leaves() for t in ([n.term] if isinstance(n, Term) else n.terms if isinstance(n, Phrase) else ())]
    fixes = correct_terms(popular, terms)
    for term in terms:
        if term in fixes:
            pattern = re.compile(rf"\b{re.escape(term)}\b(?!:)", re.I)
            text, n = pattern.subn(fixes[term], text, count=1)
            if n and pattern.search(text):
                return None
    return text if fixes else None


def note_query(query: Node) -> list[str]:
    """Terms of a query that had matches, for completions in queries mode."""
    return sorted({t for _, t in query.positive_terms()})
