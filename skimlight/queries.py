"""The registered queries of the engine's own operators, with the SQL that gives the same rows.

Tables play the engine's parts: ``documents.text`` is the field ``text``, lang and source
are categories, numbers are variables, ``events`` is a change log. Every query runs over
whole tables. Scores are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import DEFAULT_FUNCTION, Range, SearchEngine, SearchRequest
from .functions.formula import Formula
from .functions.text import analyzer, analyzers, fold
from .operators import changes as C
from .operators import postings as P
from .operators import ranking as R
from .operators import suggest as S
from .plans.query import MatchAll, Phrase
from .sources import changelog
from .sources.documents import from_table, spread
from .sources.folders import scratch_folder
from .streaming import ingest as stream

NOW = 1_706_745_600  # 2024-02-01
SIMPLE = {"default": {"analyzer": "simple"}}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of documents.text, built from the raw table."""
    return P.build_postings(spread(P.field_of(table(spark, sf, "documents"), "doc_id", "text")), analyzers(SIMPLE))


#: Indexes of this process, by application, tables and kind: each is built once, and searches read what is stored.
_ENGINES: dict[tuple[str, str, str], SearchEngine] = {}


def engine(spark: SparkSession, sf: str, kind: str = "documents") -> SearchEngine:
    """A stored index over one of the tables: ``documents``, ``standard`` (the default analyzer), ``part``, or ``changed`` (documents and later changes)."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _ENGINES:
        config = {"standard": {}, "part": {"default": {"analyzer": "simple"}, "perField": {"brand": {"analyzer": "keyword"}}}}.get(kind, SIMPLE)
        new = SearchEngine(spark, f"{scratch_folder(spark)}/{kind}", n_vars=2, analyzer_config=config)
        if kind == "part":
            new.recover(from_table(table(spark, sf, "part"), "p_partkey", {"name": "p_name", "brand": "p_brand"}))
        else:
            docs = spread(table(spark, sf, "documents"))
            stamp = F.lit(1_700_000_000) + F.col("doc_id") * 60
            new.recover(from_table(docs, "doc_id", {"text": "text"}, ["n_chars", F.col("doc_id") % 97], {"lang": "lang", "source": "source"}, stamp))
        for number, formula in FUNCTIONS.items():
            new.add_function(number, formula)
        if kind == "changed":
            change(new, table(spark, sf, "documents"), table(spark, sf, "labels"))
        _ENGINES[key] = new
    return _ENGINES[key]


#: Scoring functions of the indexes, by number; 0 is there from the start.
FUNCTIONS = {1: "relevance", 2: "relevance * d[0]", 3: "relevance * 100 + log(d[0] + 1) - age / 1000000", 4: "d[1] - age / 1000000"}


def change(index: SearchEngine, docs: DataFrame, labels: DataFrame) -> None:
    """Four batches: toxic documents are deleted, other labelled ones get a new text, then variables, categories and times change."""
    name = F.col("doc_id").cast("string").alias("docid")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    index.apply(toxic.select(name, F.lit(True).alias("deleted")))
    newer = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").join(toxic, "doc_id", "left_anti")
    index.apply(newer.select(name, F.create_map(F.lit("text"), F.concat(F.lit("the "), "lang")).alias("fields")))
    rest = docs.join(toxic, "doc_id", "left_anti")
    index.apply(rest.where("doc_id % 10 = 0").select(name, F.create_map(F.lit(1), F.lit(-1.0)).alias("variables")))
    moved = F.create_map(F.lit("lang"), F.lit(""), F.lit("source"), F.lit("moved"))
    index.apply(rest.where("doc_id % 7 = 0").select(name, F.lit(1_600_000_000).alias("ts"), moved.alias("categories")))


def found(spark: SparkSession, sf: str, text, kind: str = "documents") -> DataFrame:
    return engine(spark, sf, kind).matches(text)


def number(column: str = "docid") -> Column:
    return F.col(column).cast("long")


def rounded(matches: DataFrame, score: str = "R", name: str = "doc_id") -> DataFrame:
    return matches.select(number().alias(name), F.round(score, 9).alias("score"))


def searched(spark: SparkSession, sf: str, text: str, function: int = 1, kind: str = "documents", **request) -> DataFrame:
    """All rows that a search matches, filters and scores."""
    return engine(spark, sf, kind).scored(SearchRequest(text, NOW, function=function, **request))


def page(spark: SparkSession, sf: str, text: str, function: int = 1, kind: str = "documents", **request) -> DataFrame:
    """A page of a search."""
    return engine(spark, sf, kind).page(SearchRequest(text, NOW, function=function, **request))


#: Postings of documents.text in SQL; a leaf is the score of one term.
POSTINGS = """
    with split as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents where text is not null),
    tokens as (select doc_id, len(t) as doc_len, unnest(t) as term, unnest(generate_series(1, len(t))) as pos from split),
    postings as (
        select doc_id, term, list(cast(pos as int) order by pos) as positions, cast(count(*) as int) as tf, cast(any_value(doc_len) as int) as doc_len
        from tokens group by doc_id, term)"""


def leaf(name: str, term: str) -> str:
    return f", {name} as (select doc_id, sqrt(tf / doc_len) as s, positions from postings where term = '{term}')"


DYNAMIC = """
    , dyn as (
        select doc_id, 1700000000 + doc_id * 60 as ts, cast(cast(n_chars as float) as double) as v0,
            cast(doc_id % 97 as double) as v1, lang, source from documents)"""

# Matching


@query(POSTINGS + leaf("a", "the") + " select doc_id, round(s, 9) as score from a")
def term_scan(spark, sf):
    return rounded(found(spark, sf, "the"))


@query(POSTINGS + leaf("a", "the") + leaf("b", "and") + " select doc_id, round((a.s + b.s) / 2, 9) as score from a join b using (doc_id)")
def and_query(spark, sf):
    return rounded(found(spark, sf, "the AND and"))


@query(
    POSTINGS + leaf("a", "the") + leaf("b", "que")
    + " select doc_id, round((coalesce(a.s, 0) + coalesce(b.s, 0)) / 2, 9) as score from a full join b using (doc_id)"
)
def or_query(spark, sf):
    return rounded(found(spark, sf, "the OR que"))


@query(POSTINGS + leaf("a", "the") + leaf("b", "with") + " select doc_id, round(s, 9) as score from a where doc_id not in (select doc_id from b)")
def not_query(spark, sf):
    return rounded(found(spark, sf, "the -with"))


@query(
    POSTINGS + leaf("a", "of") + leaf("b", "the")
    + """ select doc_id, round(1 + a.s + b.s, 9) as score from a join b using (doc_id)
    where list_has_any(a.positions, list_transform(b.positions, lambda p: p - 1))"""
)
def phrase_query(spark, sf):
    return rounded(found(spark, sf, '"of the"'))


@query(
    POSTINGS + leaf("a", "of") + leaf("b", "the")
    + """ select doc_id, round(1 + a.s + b.s, 9) as score from a join b using (doc_id)
    where list_has_any(a.positions, list_transform(b.positions, lambda p: p - 2))"""
)
def phrase_gap_query(spark, sf):
    return rounded(found(spark, sf, Phrase("text", ("of", "the"), (0, 2))))


#: A prefix stands for the first 1000 of its terms at most.
PREFIX = """, terms as (select distinct term from postings where starts_with(term, '{0}') order by term limit 1000)
    select doc_id, round(sqrt(sum(tf / doc_len)), 9) as score from postings where term in (select term from terms) group by doc_id"""


@query(POSTINGS + PREFIX.format("tha"))
def prefix_query(spark, sf):
    return rounded(found(spark, sf, "tha*"))


@query(POSTINGS + PREFIX.format("a"))
def prefix_term_cap(spark, sf):
    return rounded(found(spark, sf, "a*"))


@query("select distinct doc_id, cast(1 as double) as score from documents")
def match_all(spark, sf):
    return rounded(found(spark, sf, MatchAll()))


@query(
    POSTINGS + leaf("a", "the") + leaf("b", "and")
    + " select doc_id, round((coalesce(a.s, 0) * 3 + coalesce(b.s, 0)) / 4, 9) as score from a full join b using (doc_id)"
)
def boosted_query(spark, sf):
    return rounded(found(spark, sf, "the^3 OR and"))


@query(
    POSTINGS + leaf("a", "the") + leaf("b", "and") + leaf("c", "of") + leaf("d", "with")
    + """, bc as (select doc_id, b.s + c.s as s from b join c using (doc_id)),
    o as (select doc_id, (coalesce(a.s, 0) + coalesce(bc.s, 0)) / 3 as s from a full join bc using (doc_id))
    select doc_id, round(s, 9) as score from o where doc_id not in (select doc_id from d)"""
)
def nested_boolean(spark, sf):
    return rounded(found(spark, sf, "(the OR (and AND of)) -with"))


@query(
    POSTINGS + leaf("a", "the") + leaf("b", "and") + leaf("c", "que")
    + """, bc as (select doc_id, coalesce(b.s, 0) + coalesce(c.s, 0) as s from b full join c using (doc_id))
    select doc_id, round((coalesce(a.s, 0) + coalesce(bc.s, 0)) / 3, 9) as score from a full join bc using (doc_id)"""
)
def mixed_operators(spark, sf):
    """``a b OR c``: OR makes its left side optional, and the fold goes to the right."""
    return rounded(found(spark, sf, "the and OR que"))


@query(POSTINGS + leaf("a", "the") + leaf("b", "and") + " select count(*) as matches from a join b using (doc_id)")
def query_count(spark, sf):
    return found(spark, sf, "the AND and").agg(F.count(F.lit(1)).alias("matches"))


@query("select count(distinct doc_id) as size from documents")
def index_size(spark, sf):
    return found(spark, sf, MatchAll()).agg(F.count(F.lit(1)).alias("size"))


@query(
    """with r as (select p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') as t from part)
    select p_partkey, round((sqrt(1 / len(t)) + sqrt(1 / len(t))) / 2, 9) as score from r where list_contains(t, 'small') and list_contains(t, 'ring')"""
)
def short_field_search(spark, sf):
    return rounded(found(spark, sf, "name:small name:ring", "part"), name="p_partkey")


# The index


@query(POSTINGS + " select 'text' as field, term, doc_id, array_to_string(positions, ' ') as positions, tf, doc_len from postings")
def postings_build(spark, sf):
    rows = postings(spark, sf).withColumn("positions", F.array_join("positions", " "))
    return rows.withColumnRenamed("docid", "doc_id")


@query(POSTINGS + " select term, count(*) as df, cast(sum(tf) as bigint) as cnt from postings group by term")
def term_stats(spark, sf):
    return P.term_stats(postings(spark, sf)).drop("field")


@query(POSTINGS + " select distinct doc_id, doc_len, round(sqrt(1 / doc_len), 9) as norm from postings")
def doc_len_norm(spark, sf):
    rows = P.tokens(spread(P.field_of(table(spark, sf, "documents"), "doc_id", "text")), analyzers(SIMPLE))
    one = rows.where("pos = 1")
    return one.select(F.col("docid").alias("doc_id"), "doc_len", F.round(F.sqrt(1 / F.col("doc_len")), 9).alias("norm"))


@query(
    POSTINGS + """ select (select count(*) from documents) as documents, count(distinct term) as terms, count(*) as postings,
    cast(sum(tf) as bigint) as tokens from postings"""
)
def engine_stats(spark, sf):
    return P.engine_stats(table(spark, sf, "documents"), postings(spark, sf))


@query(
    """with split as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
    tokens as (select doc_id, unnest(t) as term, unnest(generate_series(1, len(t))) as pos from split)
    select doc_id, cast(pos as int) as pos, term from tokens where term not in ('the', 'of', 'and', 'to', 'a', 'de', 'la', 'que', 'en')"""
)
def stopword_filter(spark, sf):
    config = {"default": {"analyzer": "simple", "stopwords": ["the", "of", "and", "to", "a", "de", "la", "que", "en"]}}
    rows = P.tokens(spread(P.field_of(table(spark, sf, "documents"), "doc_id", "text")), analyzers(config))
    return rows.select(F.col("docid").alias("doc_id"), "pos", "term")


@query(
    r"""with split as (select doc_id, regexp_extract_all(strip_accents(lower(replace(text, 'ß', 'ss'))), '[a-z0-9]+') as t from documents),
    tokens as (select doc_id, unnest(t) as term from split)
    select term, count(*) as cnt from tokens group by term"""
)
def ascii_fold(spark, sf):
    terms = F.regexp_extract_all(fold(F.lower("text")), F.lit("[a-z0-9]+"), F.lit(0))
    rows = spread(table(spark, sf, "documents").select("text")).select(F.explode(terms).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    """with split as (
        select p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') as t, p_brand from part)
    select p_partkey, round((sqrt(1 / len(t)) + 1) / 2, 9) as score from split where list_contains(t, 'red') and p_brand = 'Brand#7'"""
)
def per_field_search(spark, sf):
    return rounded(found(spark, sf, 'name:red AND brand:"Brand#7"', "part"), name="p_partkey")


# Order and pages: identifiers are strings, and are ordered as such


BY_ID = "cast(doc_id as varchar)"


@query(POSTINGS + leaf("a", "the") + leaf("b", "and") + f" select doc_id, round((a.s + b.s) / 2, 9) as score from a join b using (doc_id) order by (a.s + b.s) / 2 desc, {BY_ID} limit 10")
def topk_relevance(spark, sf):
    return rounded(page(spark, sf, "the AND and"), "score")


@query(POSTINGS + leaf("a", "the") + f" select doc_id, round(s, 9) as score from a order by s desc, {BY_ID} limit 10 offset 20")
def topk_paged(spark, sf):
    return rounded(page(spark, sf, "the", start=20), "score")


@query(POSTINGS + leaf("a", "the") + DYNAMIC + f" select doc_id, cast(ts - {NOW} as double) as score from a join dyn using (doc_id) order by score desc, {BY_ID} limit 10")
def topk_age(spark, sf):
    return rounded(page(spark, sf, "the", function=0), "score")


@query(POSTINGS + leaf("a", "the") + DYNAMIC + f" select doc_id, cast(ts - {NOW} as double) as score from a join dyn using (doc_id) order by score desc, {BY_ID} limit 10")
def unknown_function(spark, sf):
    """A number without a function scores by age."""
    return rounded(page(spark, sf, "the", function=99), "score")


@query(
    POSTINGS + leaf("a", "and")
    + f" select doc_id, score from (select 7 as doc_id, 1.7976931348623157e308 as score union all select doc_id, round(s, 9) from a where doc_id <> 7) order by score desc, {BY_ID} limit 10"
)
def promoted_result(spark, sf):
    """A promotion stored with the index is looked up by the query in any case."""
    engine(spark, sf).promote("7", "And")
    return rounded(page(spark, sf, "and"), "score")


@query(f"select doc_id, text from documents where text is not null order by {BY_ID} limit 20")
def stored_by_id(spark, sf):
    rows = engine(spark, sf).documents().where(F.try_element_at("fields", F.lit("text")).isNotNull()).orderBy("docid").limit(20)
    return rows.select(number().alias("doc_id"), F.try_element_at("fields", F.lit("text")).alias("text"))


# Formulas, over orders: doc.var[0] the price, doc.var[1] the day of the month, age since the order


def formula_scores(spark: SparkSession, sf: str, text: str, query_vars: Mapping[int, float] = {}, digits: int = 6) -> DataFrame:
    orders = table(spark, sf, "orders")
    values = [F.col("o_totalprice"), (F.col("o_orderkey") % 31).cast("double")]
    age = F.lit(NOW) - F.unix_timestamp("o_orderdate")
    score = Formula(text).column((F.col("o_orderkey") % 100) / 100, age, lambda i: values[i], query_vars)
    return orders.select("o_orderkey", F.round(score, digits).alias("score"))


FORMULA = f"""
    with o as (
        select o_orderkey, (o_orderkey % 100) / 100 as r, cast({NOW} - epoch(o_orderdate) as double) as age,
            cast(cast(o_totalprice as float) as double) as v0, cast(o_orderkey % 31 as double) as v1 from orders)
    select o_orderkey, round({{}}, 6) as score from o"""


@query(FORMULA.format("r * 2 + age / 3600 - v0 * 0.5 + -v1").replace("6)", "9)"))
def score_arith(spark, sf):
    return formula_scores(spark, sf, "relevance * 2 + age / 3600 - doc.var[0] * 0.5 + -doc.var[1]", digits=9)


@query(FORMULA.format("case when v1 > 0 then ln(v1) else cast('-infinity' as double) end + sqrt(v0)"))
def score_log_sqrt(spark, sf):
    return formula_scores(spark, sf, "log(d[1]) + sqrt(d[0])")


@query(FORMULA.format("pow(v1 / 10, 3) + 1 / pow(v1 + 1, 2) + pow(v0, 0)"))
def score_pow_int(spark, sf):
    return formula_scores(spark, sf, "pow(d[1] / 10, 3.7) + pow(d[1] + 1, -2) + pow(d[0], 0.5)")


@query(FORMULA.format("least(v1, 15) + greatest(r, 0.5) + abs(v1 - 20)"))
def score_min_max_abs(spark, sf):
    return formula_scores(spark, sf, "min(d[1], 15) + max(rel, 0.5) + abs(d[1] - 20)")


@query(FORMULA.format("case when v1 = 15 then cast('infinity' as double) else (v1 + 1) / (v1 - 15) end"))
def score_divide_by_zero(spark, sf):
    return formula_scores(spark, sf, "(d[1] + 1) / (d[1] - 15)")


def geo_scores(spark: SparkSession, sf: str, name: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    places = [(F.col("c_custkey") % 181 - 90).cast("double"), (F.col("c_custkey") % 361 - 180).cast("double")]
    score = Formula(f"{name}(d[0], d[1], q[0], q[1])").column(F.lit(0.0), F.lit(0), lambda i: places[i], [40.7, -74.0])
    return customers.select("c_custkey", F.round(score, 6).alias("score"))


GEO = """
    with c as (select c_custkey, cast(c_custkey % 181 - 90 as double) as lat, cast(c_custkey % 361 - 180 as double) as lon from customer)
    select c_custkey, round({} * sqrt((lat - 40.7) * (lat - 40.7) + (lon + 74.0) * (lon + 74.0) * pow(cos(radians(cast(trunc(trunc(lat + 40.7) / 2) as double))), 2)), 6) as score from c"""


@query(GEO.format(111.133))
def score_km(spark, sf):
    return geo_scores(spark, sf, "km")


@query(GEO.format(69.055))
def score_miles(spark, sf):
    return geo_scores(spark, sf, "miles")


@query(FORMULA.format("cast((cast(v1 as int) >> 2) & 1 as double) + cast((cast(v1 as int) >> 0) & 1 as double)"))
def score_bit(spark, sf):
    return formula_scores(spark, sf, "bit(d[1], 2) + bit(d[1], 0)")


@query(FORMULA.format("case when v1 >= 15 then v0 else case when r = 0.5 then 1 else -age end end"))
def score_if(spark, sf):
    return formula_scores(spark, sf, "if(d[1] >= 15, d[0], if(R = 0.5, 1, -A))")


@query(FORMULA.format("r * 2.5 + v1 * 0.25"))
def score_query_var(spark, sf):
    return formula_scores(spark, sf, "R * query.var[0] + d[1] * q[3]", {0: 2.5, 3: 0.25})


@query(FORMULA.format("v0 + v1"))
def score_doc_var(spark, sf):
    return formula_scores(spark, sf, "boost(0) + dvar[1]")


# Filters and facets


@query(POSTINGS + leaf("a", "the") + DYNAMIC + " select doc_id, round(s, 9) as score from a join dyn using (doc_id) where lang in ('en', 'de') and source in ('src1', 'src2', 'src3')")
def facet_filter_and_or(spark, sf):
    return rounded(searched(spark, sf, "the", facets={"lang": ["en", "de"], "source": ["src1", "src2", "src3"]}), "score")


@query(POSTINGS + leaf("a", "the") + DYNAMIC + " select doc_id, round(s, 9) as score from a join dyn using (doc_id) where (v0 <= 500 or v0 between 1000 and 2000) and v1 >= 40")
def variable_range_filter(spark, sf):
    ranges = [Range(0, None, 500), Range(0, 1000, 2000), Range(1, 40)]
    return rounded(searched(spark, sf, "the", variable_ranges=ranges), "score")


@query(POSTINGS + leaf("a", "the") + DYNAMIC + " select doc_id, round(s, 9) as score from a join dyn using (doc_id) where s * v0 between 100 and 400")
def function_range_filter(spark, sf):
    return rounded(searched(spark, sf, "the", function_ranges=[Range(2, 100, 400)]), "score")


FACETS = " select category, value, count(*) as cnt from (select 'lang' as category, lang as value from m union all select 'source', source from m) where value <> '' group by all"


@query(POSTINGS + leaf("a", "the") + DYNAMIC + ", m as (select * from a join dyn using (doc_id))" + FACETS)
def facet_counts(spark, sf):
    return R.facet_counts(searched(spark, sf, "the"))


@query(POSTINGS + leaf("a", "the") + DYNAMIC + ", m as (select * from a join dyn using (doc_id) where lang = 'en' and v1 < 50)" + FACETS)
def facet_counts_filtered(spark, sf):
    return R.facet_counts(searched(spark, sf, "the", facets={"lang": ["en"]}, variable_ranges=[Range(1, None, 49)]))


@query("""select category, value, count(*) as cnt from (
    select 'quality' as category, cast(quality as varchar) as value from documents left join labels using (doc_id)
    union all select 'lang', lang from documents left join labels using (doc_id)) where value is not null group by all""")
def facet_counts_absent(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.facet_counts_of(rows, ["quality", "lang"])


@query(POSTINGS + leaf("a", "the") + "select a.doc_id, round(s, 9) as score, coalesce(l.quality, 0) as quality from a left join labels l using (doc_id)")
def missing_dynamic_data(spark, sf):
    marks = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("docid")).agg(F.max("quality").alias("quality"))
    rows = found(spark, sf, "the").withColumn("docid", number()).join(marks, "docid", "left")
    return rows.select(F.col("docid").alias("doc_id"), F.round("R", 9).alias("score"), F.coalesce("quality", F.lit(0)).alias("quality"))


# Fetching


PAGE = POSTINGS + leaf("a", "the") + f", page as (select doc_id, s from a order by s desc, {BY_ID} limit 10)"


@query(PAGE + " select doc_id, round(s, 9) as score, text from page join documents using (doc_id)")
def fetch_fields(spark, sf):
    rows = page(spark, sf, "the", fetch_fields=["*"])
    return rows.select(number().alias("doc_id"), F.round("score", 9).alias("score"), F.col("fields")["text"].alias("text"))


@query(PAGE + DYNAMIC + " select doc_id, cast(v0 as float) as variable_0, cast(v1 as float) as variable_1 from page join dyn using (doc_id)")
def fetch_variables(spark, sf):
    rows = page(spark, sf, "the", fetch_variables=True)
    return rows.select(number().alias("doc_id"), F.get("vars", F.lit(0)).alias("variable_0"), F.get("vars", F.lit(1)).alias("variable_1"))


@query(PAGE + DYNAMIC + " select doc_id, lang as category_lang, source as category_source from page join dyn using (doc_id)")
def fetch_categories(spark, sf):
    rows = page(spark, sf, "the", fetch_categories=True)
    return rows.select(number().alias("doc_id"), F.col("cats")["lang"].alias("category_lang"), F.col("cats")["source"].alias("category_source"))


@query()
def snippets(spark, sf):
    """Highlighted windows of the ten best documents; beyond SQL, tested against literal cases."""
    return page(spark, sf, "the AND and", snippet_fields=["text"]).select(number().alias("doc_id"), F.col("snippet_text").alias("snippet"))


# Suggestions


@query(POSTINGS + " select term, cast(sum(tf) as bigint) as cnt from postings where starts_with(term, 'th') group by term order by cnt desc, term limit 5")
def autocomplete_terms(spark, sf):
    return S.complete_terms(engine(spark, sf).popular_terms(), "text", "th")


@query(
    POSTINGS + """, p as (select term, cast(sum(tf) as bigint) as cnt from postings group by term),
    x as (select substr(term, 1, n) as prefix, term, cnt from p, range(1, 4) r(n) where n <= length(term)),
    y as (select *, row_number() over (partition by prefix order by cnt desc, term) as k from x)
    select prefix, term, cnt, cast(k as int) as "rank" from y where k <= 5"""
)
def autocomplete_table(spark, sf):
    return S.best_by_prefix(engine(spark, sf).popular_terms().where("field = 'text'"), 3).drop("field")


@query("""with q as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from conversations where role = 'user')
    select term, count(*) as cnt from q where starts_with(term, 'en') group by term order by cnt desc, term limit 5""")
def autocomplete_queries(spark, sf):
    """Past queries are the users' turns."""
    log = table(spark, sf, "conversations").where("role = 'user'")
    terms = log.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return S.complete_terms(terms.groupBy(F.lit("").alias("field"), "term").agg(F.count(F.lit(1)).alias("cnt")), "", "en")


@query(POSTINGS + " select term, cast(sum(tf) as bigint) as cnt from postings where levenshtein(term, 'thatt') <= 1 group by term")
def fuzzy_neighbours(spark, sf):
    return S.neighbours(engine(spark, sf).popular_terms(), "thatt")


@query(POSTINGS + """, n as (select term, sum(tf) as cnt from postings where levenshtein(term, 'thatt') <= 1 group by term)
    select 'thatt' as asked, (select term from n order by cnt desc, term limit 1) as term where not exists (select 1 from n where term = 'thatt')""")
def did_you_mean(spark, sf):
    fixes = S.correct_terms(engine(spark, sf).popular_terms(), ["thatt"])
    return spark.createDataFrame(list(fixes.items()), "asked string, term string")


# The change log: users of events are documents; errors delete, sign-ups set fields, all else updates


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    deleted = F.col("event_type") == "error"
    signup = F.col("event_type") == "signup"
    key = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2)
    return e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 7).cast("string").alias("index_code"), F.col("user_id").cast("string").alias("docid"),
        deleted.alias("deleted"), F.unix_timestamp("ts").cast("int").alias("ts"),
        F.when(signup, F.create_map(F.lit("text"), F.col("props"))).alias("fields"),
        F.when(key.isNotNull(), F.create_map(key, "value")).alias("variables"),
        F.when(F.col("event_type") == "purchase", F.create_map(F.lit("size"), F.when(F.col("value") > 20, "large").otherwise("small"))).alias("categories"),
    )


#: The same by user, in SQL: what has happened since the last delete.
FOLD = """
    with l as (
        select *, max(case when event_type = 'error' then event_id end) over (partition by user_id) as cleared from events),
    alive as (select * from l where cleared is null or event_id > cleared),
    users as (select user_id, max(event_id) as seq, arg_max(event_type, event_id) = 'error' as deleted from events group by user_id),
    state as (
        select u.user_id, u.seq, u.deleted,
            arg_max(a.props, a.event_id) filter (where a.event_type = 'signup') as body,
            arg_max(a.value, a.event_id) filter (where a.event_type = 'click') as v0,
            arg_max(a.value, a.event_id) filter (where a.event_type = 'view') as v1,
            arg_max(a.value, a.event_id) filter (where a.event_type = 'purchase') as v2,
            arg_max(case when a.value > 20 then 'large' else 'small' end, a.event_id) filter (where a.event_type = 'purchase') as size
        from users u left join alive a using (user_id) group by all)"""


def flat(state: DataFrame) -> DataFrame:
    return state.select(
        "docid", F.try_element_at("fields", F.lit("text")).alias("body"),
        *[F.try_element_at("variables", F.lit(i)).alias(f"v{i}") for i in range(3)], F.try_element_at("categories", F.lit("size")).alias("size"),
    )


@query(FOLD + " select cast(user_id as varchar) as docid, seq, deleted, body, v0, v1, v2, size from state")
def log_fold(spark, sf):
    state = C.fold(events_log(spark, sf))
    return flat(state).join(state.select("docid", "seq", "deleted"), "docid")


@query(FOLD + " select cast(user_id as varchar) as docid, body, v0, v1, v2, size from state where not deleted")
def log_compaction(spark, sf):
    """An older half folded to a base, and the newer half merged onto it without tombstones."""
    log = events_log(spark, sf)
    middle = log.agg((F.max("seq") / 2).cast("long")).first()[0]
    half = F.col("seq") <= middle
    return flat(C.compact(C.fold(log.where(half)), log.where(~half)))


@query(FOLD + " select cast(user_id as varchar) as docid, body from state where not deleted and body is not null")
def log_replay_index(spark, sf):
    return flat(C.live(C.fold(events_log(spark, sf)))).select("docid", "body")


@query("select cast(user_id % 7 as varchar) as index_code, count(*) as records, count(distinct user_id) as documents, max(event_id) as \"last\" from events group by 1")
def log_demux(spark, sf):
    return changelog.log_info(changelog.records(events_log(spark, sf)))


@query("select cast(user_id % 7 as varchar) as index_code, count(*) as records, count(distinct user_id) as documents, max(event_id) as \"last\" from events group by 1")
def stream_deal(spark, sf):
    """The same log, appended to as it comes, read as a stream and dealt into one folder per index."""
    folder = scratch_folder(spark)
    out = f"{folder}/dealt"
    changelog.append(events_log(spark, sf), f"{folder}/log")
    stream.deal(stream.open_log(spark, f"{folder}/log"), out, f"{folder}/offsets", once=True).awaitTermination()
    return changelog.log_info(changelog.read(spark, out).withColumn("index_code", F.col("index_code").cast("string")))


@query(FOLD + """ select cast(user_id as varchar) as docid, cast(coalesce(v0, 0) as float) as v0, cast(coalesce(v1, 0) as float) as v1,
    cast(coalesce(v2, 0) as float) as v2 from state where not deleted""")
def update_variables(spark, sf):
    rows = C.dynamic_of(C.fold(events_log(spark, sf)), 3)
    return rows.select("docid", *[F.get("vars", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query(FOLD + " select cast(user_id as varchar) as docid, size from state where not deleted and size <> 'small'")
def update_categories(spark, sf):
    """An empty value removes the category."""
    log = events_log(spark, sf)
    emptied = F.transform_values("categories", lambda k, v: F.when(v == "small", "").otherwise(v))
    rows = C.dynamic_of(C.fold(log.withColumn("categories", emptied)), 3)
    return rows.select("docid", F.try_element_at("cats", F.lit("size")).alias("size")).where("size is not null")


#: The index ``changed``: what is left, with its newest text, variables, categories and time.
CHANGED = """
    with now as (
        select doc_id, case when doc_id in (select doc_id from labels) then 'the ' || lang else text end as body,
            cast(cast(n_chars as float) as double) as v0, cast(case when doc_id % 10 = 0 then -1 else doc_id % 97 end as double) as v1,
            case when doc_id % 7 = 0 then 1600000000 else 1700000000 + doc_id * 60 end as ts,
            case when doc_id % 7 = 0 then 'moved' else source end as source, case when doc_id % 7 = 0 then null else lang end as lang
        from documents where doc_id not in (select doc_id from labels where toxic = 1)),
    split as (select *, regexp_extract_all(lower(body), '[a-z0-9]+') as t from now where body is not null),
    m as (select *, sqrt(len(list_filter(t, lambda x: x = 'the')) / len(t)) as s from split where list_contains(t, 'the'))"""


@query(CHANGED + " select doc_id, round(s, 9) as score from m where doc_id not in (select doc_id from labels)")
def delete_documents(spark, sf):
    """Deleted documents match no more; those with a new text are left aside here."""
    marked = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("docid")).distinct()
    return rounded(found(spark, sf, "the", "changed").join(marked, "docid", "left_anti"))


@query(CHANGED + " select doc_id, round(s, 9) as score from m")
def tier_blend(spark, sf):
    """Documents with a newer text match by it alone, whatever the older one scored."""
    return rounded(found(spark, sf, "the", "changed"))


@query(CHANGED + f" select doc_id, round(v1 - ({NOW} - ts) / 1e6, 9) as score from m where v1 <= 50")
def updated_search(spark, sf):
    """Changed variables and times in a filter and a formula."""
    return rounded(searched(spark, sf, "the", 4, "changed", variable_ranges=[Range(1, None, 50)]), "score")


@query(CHANGED + FACETS.replace("value <> ''", "value is not null and value <> ''"))
def updated_facets(spark, sf):
    return R.facet_counts(searched(spark, sf, "the", 1, "changed"))


@query(CHANGED + " select doc_id, ts, v0, v1, lang, source from now")
def dynamic_snapshot(spark, sf):
    rows = engine(spark, sf, "changed").dynamic()
    return rows.select(
        number().alias("doc_id"), F.col("ts").cast("long").alias("ts"), *[F.get("vars", F.lit(i)).cast("double").alias(f"v{i}") for i in (0, 1)],
        *[F.try_element_at("cats", F.lit(c)).alias(c) for c in ("lang", "source")],
    )


@query(CHANGED + " select doc_id, body from now where body is not null")
def stored_documents(spark, sf):
    rows = engine(spark, sf, "changed").documents()
    return rows.select(number().alias("doc_id"), F.try_element_at("fields", F.lit("text")).alias("body")).where("body is not null")


# The default analyzer, chains of filters, the stored index itself


STANDARD = r"""
    with split as (
        select doc_id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}]+(?:[.''’][\p{L}\p{N}]+)*') as t from documents where text is not null),
    tokens as (select doc_id, len(t) as doc_len, unnest(t) as term from split)"""


@query(STANDARD + " select term, count(distinct doc_id) as df, count(*) as cnt from tokens group by term")
def standard_terms(spark, sf):
    return engine(spark, sf, "standard").store.term_stats().where("field = 'text'").select("term", "df", "cnt")


@query(STANDARD + " select doc_id, round(sqrt(count(*) / any_value(doc_len)), 9) as score from tokens where term = 'uber' group by doc_id")
def standard_search(spark, sf):
    return rounded(found(spark, sf, "Über", "standard"))


@query("""with split as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
    tokens as (select doc_id, unnest(t) as term from split)
    select substr(term, 1, 4) as term, count(*) as cnt from tokens where term not in ('the', 'and') group by 1""")
def filter_chain(spark, sf):
    """Stop words out, then terms cut to four letters."""
    chain = analyzer({"analyzer": "simple", "filters": [{"filter": "stop", "stopwords": ["the", "and"]}, {"filter": "truncate", "length": 4}]})
    rows = spread(table(spark, sf, "documents").select("text")).select(F.explode(chain(F.col("text"))).alias("t"))
    return rows.groupBy("t.term").agg(F.count(F.lit(1)).alias("cnt"))


@query(POSTINGS + " select doc_id, array_to_string(positions, ' ') as positions, tf, doc_len from postings where term = 'the'")
def posting_scan(spark, sf):
    rows = engine(spark, sf).postings().where("field = 'text' and term = 'the'")
    return rows.select(number().alias("doc_id"), F.array_join("positions", " ").alias("positions"), "tf", "doc_len")


@query(POSTINGS + " select term, cast(sum(tf) as bigint) as cnt from postings group by term")
def term_popularity(spark, sf):
    return engine(spark, sf).popular_terms().where("field = 'text'").select("term", "cnt")


@query(POSTINGS + """, n as (select term, sum(tf) as cnt from postings where levenshtein(term, 'thatt') <= 1 group by term)
    select case when exists (select 1 from n where term = 'thatt') then null else (select term from n order by cnt desc, term limit 1) end as did_you_mean""")
def corrected_query(spark, sf):
    """What a search offers for a misspelt term."""
    result = engine(spark, sf).search(SearchRequest("thatt", NOW))
    result.close()
    return spark.createDataFrame([(result.did_you_mean,)], "did_you_mean string")


# All together


@query(
    POSTINGS + leaf("a", "the") + leaf("b", "and") + DYNAMIC
    + f""", m as (select doc_id, (a.s + b.s) / 2 as r, ts, v0, lang from a join b using (doc_id) join dyn using (doc_id) where lang = 'en')
    select doc_id, round(r * 100 + ln(v0 + 1) - ({NOW} - ts) / 1e6, 9) as score, lang from m order by r * 100 + ln(v0 + 1) - ({NOW} - ts) / 1e6 desc, {BY_ID} limit 10"""
)
def flagship(spark, sf):
    """A query string, a facet filter, a scoring formula, the best ten of a stored index."""
    rows = page(spark, sf, "the AND and", 3, facets={"lang": ["en"]}, fetch_categories=True)
    return rows.select(number().alias("doc_id"), F.round("score", 9).alias("score"), F.col("cats")["lang"].alias("lang"))
