"""Lowering of a query tree to one scan and one aggregation of the postings.

All leaves are read in a single pass over ``postings`` (the filter on field and term
reaches the Parquet scan), and one ``groupBy(docid)`` turns them into columns; the tree
is then an expression over these columns. However many terms a query has, it shuffles
once, and only what matches a leaf.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import And, Difference, InvalidQuery, MatchAll, Node, Or, Phrase, Prefix, Term, TermRange

#: Terms that a prefix stands for at most, in order.
PREFIX_TERMS = 1000


def term_is(field: str, term: str) -> Column:
    return (F.col("field") == field) & (F.col("term") == term)


def prefix_is(field: str, prefix: str, last: str | None = None) -> Column:
    found = (F.col("field") == field) & F.col("term").startswith(prefix)
    return found if last is None else found & (F.col("term") <= last)


def last_prefix_term(term_stats: DataFrame, field: str, prefix: str, cap: int = PREFIX_TERMS) -> str | None:
    """The cap-th term of a prefix in order, or None if it has no more terms than that."""
    terms = term_stats.where(prefix_is(field, prefix)).select("term").distinct().orderBy("term").limit(cap + 1).collect()
    return terms[cap - 1].term if len(terms) > cap else None


def terms_of(query: Node) -> Callable[[Column], Column]:
    """Whether a term (of any field) is one that the query reads: for postings built only for it."""
    terms = sorted({t for n in query.leaves() for t in ([n.term] if isinstance(n, Term) else n.terms if isinstance(n, Phrase) else [])})
    prefixes = sorted({n.prefix for n in query.leaves() if isinstance(n, Prefix)})
    return lambda term: reduce(lambda a, b: a | b, [term.isin(terms), *(term.startswith(p) for p in prefixes)])


def match(postings: DataFrame, query: Node, docs: DataFrame | None = None, term_stats: DataFrame | None = None) -> DataFrame:
    """(docid, R): matching documents and their normalised relevance.

    ``postings``: field, term, docid, positions, tf, doc_len. ``docs`` (docid) is read
    only if the tree holds MatchAll. With ``term_stats`` prefixes are capped at
    PREFIX_TERMS terms.
    """
    leaves = list(dict.fromkeys(n for n in query.leaves()))
    if any(isinstance(n, TermRange) for n in leaves):
        raise InvalidQuery("Range queries not supported yet")
    wanted: dict[tuple, Column] = {}  # one per distinct term or prefix
    for n in leaves:
        if isinstance(n, Term):
            wanted["t", n.field, n.term] = term_is(n.field, n.term)
        elif isinstance(n, Phrase):
            wanted |= {("t", n.field, t): term_is(n.field, t) for t in n.terms}
        elif isinstance(n, Prefix):
            last = last_prefix_term(term_stats, n.field, n.prefix) if term_stats is not None else None
            wanted["p", n.field, n.prefix] = prefix_is(n.field, n.prefix, last)
    number = {k: i for i, k in enumerate(wanted)}
    placed = {("t", n.field, t) for n in leaves if isinstance(n, Phrase) for t in n.terms}
    whole = any(isinstance(n, MatchAll) for n in leaves)
    if whole and docs is None:
        raise ValueError("matching all documents needs the documents")
    aggregates = []
    for key, condition in wanted.items():
        i = number[key]
        # of one document and field; √tf times the norm, or for a prefix the root of the sum of squares
        weight = F.col("tf") / F.col("doc_len")
        aggregates.append(F.sum(F.when(condition, weight)).alias(f"w{i}"))
        if key in placed:
            aggregates.append(F.max(F.when(condition, F.col("positions"))).alias(f"at{i}"))
    if wanted:
        scan = postings.where(reduce(lambda a, b: a | b, wanted.values()))
        table = scan.groupBy("docid").agg(*aggregates)
    if whole:
        table = docs.select("docid").distinct().join(table, "docid", "left") if wanted else docs.select("docid").distinct()

    def score_of(key: tuple) -> Column:
        return F.sqrt(F.col(f"w{number[key]}"))

    def found(key: tuple) -> Column:
        return F.col(f"w{number[key]}").isNotNull()

    def shift(positions: Column, by: int) -> Column:
        return F.transform(positions, lambda p: p - by)

    def lower(n: Node) -> tuple[Column, Column]:
        """Whether the node matches, and its score where it does."""
        match n:
            case MatchAll():
                return F.lit(True), F.lit(1.0)
            case Term():
                return found(("t", n.field, n.term)), score_of(("t", n.field, n.term))
            case Prefix():
                return found(("p", n.field, n.prefix)), score_of(("p", n.field, n.prefix))
            case Phrase():
                keys = [("t", n.field, t) for t in n.terms]
                shifted = [shift(F.col(f"at{number[k]}"), by) for k, by in zip(keys, n.positions, strict=True)]
                together = F.size(reduce(F.array_intersect, shifted)) > 0 if len(shifted) > 1 else F.lit(True)
                return reduce(lambda a, b: a & b, map(found, keys)) & together, reduce(lambda a, b: a + b, map(score_of, keys), F.lit(1.0))
            case And() | Or() | Difference():
                (lf, ls), (rf, rs) = lower(n.left), lower(n.right)
                ls, rs = ls * float(n.left.boost), rs * float(n.right.boost)
                if isinstance(n, And):
                    return lf & rf, ls + rs
                if isinstance(n, Difference):
                    return lf & ~F.coalesce(rf, F.lit(False)), ls
                return lf | rf, F.when(lf, ls).otherwise(0.0) + F.when(rf, rs).otherwise(0.0)
        raise InvalidQuery(f"cannot run {n}")

    flag, score = lower(query)
    return table.where(flag).select("docid", (score / float(query.norm)).alias("R"))
