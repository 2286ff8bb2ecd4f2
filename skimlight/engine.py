"""A search index: documents, variables, categories, scoring functions and queries.

``SearchEngine`` keeps its tables in a ``Store``. Searches are lazy plans over them:
one scan of the postings, one shuffle by document, filters and the scoring formula as
expressions, and a top-k; facets and the total come from the same match set.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formula import Formula
from .functions.snippets import snippet_column
from .functions.text import analyzers
from .operators import changes as C
from .operators import postings as P
from .operators import ranking as R
from .operators import suggest as S
from .operators.filters import Range, facet_filter, function_range_filter, range_filter
from .plans.match import match
from .plans.query import InvalidQuery, MatchAll, Node, parse
from .sources.documents import valid
from .sources.store import Store

__all__ = ["Busy", "InvalidQuery", "Range", "SearchEngine", "SearchRequest", "SearchResult"]

#: The function that is there from the start: newest first.
DEFAULT_FUNCTION = "0-A"
#: Below so many matches a correction of the query is looked for.
FEW_MATCHES = 10
#: Deltas after which the base is rewritten.
MOST_DELTAS = 8
#: Pages up to so many rows are broadcast to the stored documents.
MOST_BROADCAST_ROWS = 10_000
#: Searches after which the terms of their queries are written.
NOTED_SEARCHES = 100


class Busy(RuntimeError):
    """Too many searches wait."""


@dataclass(frozen=True)
class SearchRequest:
    query: str
    now: int
    start: int = 0
    limit: int = 10
    function: int = 0
    query_vars: Mapping[int, float] = field(default_factory=dict)
    facets: Mapping[str, Sequence[str]] = field(default_factory=dict)
    variable_ranges: Sequence[Range] = ()
    function_ranges: Sequence[Range] = ()
    fetch_fields: Sequence[str] = ()
    fetch_variables: bool = False
    fetch_categories: bool = False
    snippet_fields: Sequence[str] = ()
    snippet_type: str = "html"


@dataclass
class SearchResult:
    """A page of rows (docid, score and what was asked for), facet counts and the total; ``close`` frees the cached matches."""

    rows: DataFrame
    facets: DataFrame
    matches: int
    did_you_mean: str | None = None
    scored: DataFrame | None = None

    def close(self) -> None:
        if self.scored is not None:
            self.scored.unpersist()


def default_function(functions: Mapping[int, Formula], number: int) -> Formula:
    """An unknown number scores by age."""
    return functions.get(number) or Formula(DEFAULT_FUNCTION)


def score_matches(
    matches: DataFrame, request: SearchRequest, functions: Mapping[int, Formula], key: str = "docid"
) -> DataFrame:
    """Filters and scores rows with R, ts, vars and cats. Filters see the relevance before it is rescored."""
    age = (F.lit(request.now) - F.coalesce("ts", F.lit(0))).cast("double")

    def variable(i: int) -> Column:
        return F.coalesce(F.get("vars", F.lit(i)), F.lit(0.0).cast("float"))

    def value(number: int) -> Column:
        return default_function(functions, number).column(F.col("R"), age, variable, request.query_vars)

    wanted = [
        facet_filter(request.facets, lambda c: F.try_element_at("cats", F.lit(c))),
        range_filter(request.variable_ranges, variable),
        function_range_filter(request.function_ranges, value),
    ]
    kept = matches.where(reduce(lambda a, b: a & b, wanted))
    return kept.withColumn("score", value(request.function))


class SearchEngine:
    """An index at ``root`` on a shared file system."""

    def __init__(
        self, spark: SparkSession, root: str, n_vars: int = 1, analyzer_config: Mapping | None = None, suggest: str = "documents",
        concurrent: int = 3, waiting: int = 100,
    ):
        self.spark, self.n_vars, self.suggest = spark, n_vars, suggest
        self.store = Store(spark, root)
        self.config = analyzer_config or {}
        self.analyze = analyzers(self.config)
        self.functions = {0: Formula(DEFAULT_FUNCTION)}
        self.functions |= {int(k): Formula(v) for k, v in self.store.manifest.functions.items()}
        self._query_terms: dict[str, int] = {}
        self._noted = 0
        self._running, self._waiting = threading.BoundedSemaphore(concurrent), threading.BoundedSemaphore(concurrent + waiting)
        self.status = "ready"

    # scoring functions and promotions

    def add_function(self, number: int, formula: str) -> None:
        self.functions[number] = Formula(formula)
        self._save_settings()

    def add_functions(self, definitions: str) -> None:
        """``number:formula`` joined by vertical bars."""
        for d in filter(None, definitions.split("|")):
            number, formula = d.split(":", 1)
            self.add_function(int(number), formula)

    def remove_function(self, number: int) -> None:
        self.functions.pop(number, None)
        self._save_settings()

    def list_functions(self) -> dict[int, str]:
        return {k: f.text for k, f in self.functions.items()}

    def promote(self, docid: str, query: str) -> None:
        """Puts a document first for exactly this query (in any case)."""
        self.store.manifest.promotions[query.lower()] = docid
        self.store.save()

    def _save_settings(self) -> None:
        self.store.manifest.functions = {str(k): f.text for k, f in self.functions.items()}
        self.store.save()

    # documents

    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def dynamic(self) -> DataFrame:
        return self.store.read("dynamic")

    def postings(self) -> DataFrame:
        return self.store.read("postings")

    def _texts(self, documents: DataFrame) -> DataFrame:
        """Postings of documents that are in one row each."""
        return P.postings_of_texts(P.long_fields(documents), self.analyze, list(self.config.get("perField", {})))

    def _state_of(self, docids: DataFrame) -> DataFrame:
        """The current state of some documents, in the shape of a fold, without their texts: new fields replace all, and a delete clears them."""
        return self.dynamic().join(docids, "docid", "left_semi").select(
            "docid", "ts", F.lit(None).cast("map<string,string>").alias("fields"),
            F.map_from_entries(F.transform("vars", lambda v, i: F.struct(i.alias("k"), v.cast("double").alias("v")))).alias("variables"),
            F.col("cats").alias("categories"),
        )

    def apply(self, changes: DataFrame, batch: int | None = None) -> None:
        """Applies change records (CHANGE_SCHEMA; seq may be missing within one batch of distinct documents).

        Writes a delta with the changed documents only; documents whose text did not change
        get no new postings. A batch number that was applied before is skipped.
        """
        manifest = self.store.manifest
        if batch is not None and batch <= manifest.last_batch:
            return
        changes = valid(_complete(changes))
        ids = changes.select("docid").distinct()
        current = C.as_changes(self._state_of(ids))
        # inside a batch, records without a number count as one and the same time
        numbered = changes.withColumn("seq", F.coalesce("seq", F.lit(0)))
        state = C.fold(current.unionByName(numbered.select(*current.columns)))
        rewrites = F.bool_or(F.col("fields").isNotNull() | F.col("deleted"))
        unordered = (F.count_if(F.col("seq").isNull()) > 0) & (F.count(F.lit(1)) > 1)
        told = F.when(unordered, F.raise_error(F.lit("several records of a document need seq"))).otherwise(rewrites)
        state = state.join(changes.groupBy("docid").agg(told.alias("texts")), "docid").persist()
        try:
            rewritten = state.where("texts")
            alive = C.live(rewritten).select("docid", "fields")
            tables = {"documents": alive, "postings": self._texts, "dynamic": C.dynamic_of(state, self.n_vars)}
            name = self.store.write(tables, rewritten.select("docid"), state.select("docid"))
        finally:
            state.unpersist()
        if manifest.base is None:
            manifest.base = name
        else:
            manifest.deltas.append(name)
        manifest.last_batch = manifest.last_batch if batch is None else batch
        self.store.save()
        if len(manifest.deltas) > MOST_DELTAS:
            self.compact()

    def compact(self) -> None:
        """Rewrites base and deltas as a new base."""
        tables = {t: self.store.read(t) for t in ("documents", "dynamic", "postings")}
        name = self.store.write(tables)
        self.store.manifest.base, self.store.manifest.deltas = name, []
        self.store.save()

    checkpoint = compact

    def recover(self, log: DataFrame) -> None:
        """Rebuilds the index from a change log. Additions without a time are left out; status is "error" if it fails."""
        self.status = "recovering"
        try:
            timed = valid(_complete(log)).where("fields is null or ts is not null or deleted")
            log = timed.withColumn("seq", F.coalesce("seq", F.lit(0)))
            state, alive = C.fold(log), C.live(C.fold_fields(log)).select("docid", "fields")
            name = self.store.write({"documents": alive, "postings": self._texts, "dynamic": C.dynamic_of(state, self.n_vars)})
            self.store.manifest.base, self.store.manifest.deltas = name, []
            self.store.save()
        except BaseException:
            self.status = "error"
            raise
        self.status = "ready"

    # queries

    def parse(self, query: str) -> Node:
        """The tree of a query. Its words are analysed as their fields are, all in one job."""
        asked: dict[tuple[str, str], list[tuple[str, int]]] = {}

        def note(field: str, text: str) -> list[tuple[str, int]]:
            asked[field, text] = [(text, 0)]
            return asked[field, text]

        parse(query, "text", note)
        words = [key for key in asked if key[0] != "documentId"]
        if words:
            row = self.spark.range(1).select(*[self.analyze(f)(F.lit(t)).alias(f"t{i}") for i, (f, t) in enumerate(words)]).first()
            asked |= {key: [(t.term, t.pos) for t in row[f"t{i}"]] for i, key in enumerate(words)}
        return parse(query, "text", lambda field, text: asked[field, text])

    def _match(self, node: Node) -> DataFrame:
        return match(self.postings(), node, self.documents(), self.store.term_stats())

    def matches(self, query: str | Node) -> DataFrame:
        """(docid, R): all documents that match, with their relevance."""
        return self._match(self.parse(query) if isinstance(query, str) else query)

    def scored(self, request: SearchRequest) -> DataFrame:
        """All that match and pass the filters, with R, ts, vars, cats and score."""
        return self._scored(self.parse(request.query), request)

    def page(self, request: SearchRequest) -> DataFrame:
        """The rows of a search alone, without facets and total."""
        node = self.parse(request.query)
        return self._fetch(R.top(self._listed(self._scored(node, request), request), request.start, request.limit), node, request)

    def _listed(self, scored: DataFrame, request: SearchRequest) -> DataFrame:
        """docid and score of all results, a promoted one among them."""
        return R.promote(scored.select("docid", "score"), self.store.manifest.promotions.get(request.query.lower()), self.spark)

    def search(self, request: SearchRequest) -> SearchResult:
        if not self._waiting.acquire(blocking=False):
            raise Busy("too many searches wait")
        try:
            with self._running:
                return self._search(request)
        finally:
            self._waiting.release()

    def _search(self, request: SearchRequest) -> SearchResult:
        node = self.parse(request.query)
        scored = self._scored(node, request).persist()
        listed = self._listed(scored, request)
        matches = listed.count()
        page = R.top(listed, request.start, request.limit)
        result = SearchResult(self._fetch(page, node, request), R.facet_counts(scored), matches, scored=scored)
        if matches and self.suggest == "queries":
            self._note(node)
        if matches < FEW_MATCHES and self.suggest == "documents":
            better = S.did_you_mean(self.popular_terms(), node, request.query)
            if better and self.count(better):
                result.did_you_mean = better
        return result

    def _note(self, node: Node) -> None:
        for term in S.note_query(node):
            self._query_terms[term] = self._query_terms.get(term, 0) + 1
        self._noted += 1
        if self._noted >= NOTED_SEARCHES:
            self.write_query_terms()

    def write_query_terms(self) -> None:
        """Adds the terms of recent queries to those stored; done every NOTED_SEARCHES searches, and before they are read."""
        counts, self._query_terms, self._noted = self._query_terms, {}, 0
        self.store.add_query_terms(counts)

    def _scored(self, node: Node, request: SearchRequest) -> DataFrame:
        return score_matches(R.with_dynamic(self._match(node), self.dynamic()), request, self.functions)

    def _fetch(self, page: DataFrame, node: Node, request: SearchRequest) -> DataFrame:
        """Stored fields, variables, categories and snippets of one page only.

        The ids of a short page go into the scans of the stored tables; a long page is joined, and not broadcast.
        """
        few = lambda df: df
        documents, dynamic = self.documents(), self.dynamic()
        if request.limit <= MOST_BROADCAST_ROWS:
            listed = page.collect()
            page = self.spark.createDataFrame(listed, page.schema)
            asked = F.col("docid").isin([r.docid for r in listed])
            few, documents, dynamic = F.broadcast, documents.where(asked), dynamic.where(asked)
        rows = page
        wanted = node.positive_terms()
        if request.fetch_fields or request.snippet_fields:
            small = few(page.select("docid"))
            stored = documents.join(small, "docid", "left_semi")
            every = "*" in request.fetch_fields
            names = list(request.fetch_fields)
            kept = F.col("fields") if every else F.map_filter("fields", lambda k, v: k.isin(names)) if names else F.map_filter("fields", lambda k, v: F.lit(False))
            snippets = [
                snippet_column({t for f, t in wanted if f == name}, request.snippet_type)(F.try_element_at("fields", F.lit(name))).alias(f"snippet_{name}")
                for name in request.snippet_fields
            ]
            rows = rows.join(stored.select("docid", kept.alias("fields"), *snippets), "docid", "left")
        if request.fetch_variables or request.fetch_categories:
            own = dynamic.join(few(page.select("docid")), "docid", "left_semi")
            zeros = F.array(*[F.lit(0.0).cast("float")] * self.n_vars)
            columns = [F.col("vars")] * request.fetch_variables + [F.col("cats")] * request.fetch_categories
            rows = rows.join(own.select("docid", *columns), "docid", "left")
            if request.fetch_variables:
                rows = rows.withColumn("vars", F.coalesce("vars", zeros))
        return rows.orderBy(F.col("score").desc(), "docid")

    def count(self, query: str) -> int:
        return self._match(self.parse(query)).count()

    def size(self) -> int:
        return self._match(MatchAll()).count()

    def stats(self) -> DataFrame:
        return P.engine_stats(self.documents(), self.postings())

    # suggestions

    def popular_terms(self) -> DataFrame:
        return P.popularity(self.store.term_stats())

    def complete(self, partial: str, field: str = "text") -> list[str]:
        if self.suggest == "documents":
            return S.complete(self.popular_terms(), partial, field)
        if self.suggest == "queries":
            self.write_query_terms()
            return S.complete_queries(self.store.query_terms(), partial)
        return [partial]


def _complete(changes: DataFrame) -> DataFrame:
    """All columns of a change record; those that are missing are not set."""
    kinds = dict(c.strip().split(" ", 1) for c in C.CHANGE_SCHEMA.split(", "))
    columns = [(F.col(c) if c in changes.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return changes.select(*columns).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
