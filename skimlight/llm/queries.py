"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .language_id import identify_languages
from .mixing import mix_sources
from .packing import pack_documents
from .quality import quality_scores
from .secrets import scan_secrets
from .simhash import simhash_groups
from .topk import exact_topk
from .url_filter import judge_urls
from .util import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Sources belong to four domains in turn; weights of domains and languages; sources weigh the same.
DOMAINS = ["web", "books", "forum", "news"]
WEIGHTS = {"domain": {"web": 4, "books": 3, "forum": 1, "news": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def domain_of(source: str) -> Column:
    """By the number at the end of the source's name; without one, the first."""
    number = F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '([0-9]{{1,9}})$', 1) as int)"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, distance=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), domain_of("source"), WEIGHTS, budget_permille=500, epochs=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).drop("mixture")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_packing, op3_html_extraction, op4_exact_dedup, op5_topk, op6_secrets, op7_quality, op8_url_filter,
        op9_mixing, op10_language_id,
    )
}


def _share_sql(level: str, parent: str, above: str, weight: str) -> str:
    """Children of a level in the order supply / weight; one whose supply is within its share of what is left gets all."""
    keys = f"{parent}, {level}" if parent else level
    same = f"using ({parent})" if parent else "on true"
    by = f"partition by {parent} order by supply / weight, {level}" if parent else f"order by supply / weight, {level}"
    return f"""
        {level}_kids as (
            select {keys}, cast(sum(supply) as bigint) as supply, any_value({weight}) as weight from leaves group by {keys}),
        {level}_left as (
            select *, budget - coalesce(cast(sum(supply) over (w rows between unbounded preceding and 1 preceding) as bigint), 0) as money,
                cast(sum(weight) over (w rows between current row and unbounded following) as bigint) as rest
            from {level}_kids join {above} {same} window w as ({by})),
        {level}_price as (
            select {parent + "," if parent else ""} max(money) as price_money, max(rest) as price_rest from {level}_left
            where supply * rest > weight * money {"group by " + parent if parent else ""}),
        {level}_quota as (
            select {keys}, case when supply * rest <= weight * money then supply else (weight * price_money) // price_rest end as budget
            from {level}_left left join {level}_price {same}),"""


def _weight_sql(level: str) -> str:
    named = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.get(level, {}).items())
    return f"case {level} {named} else 1 end" if named else "1"


MIXING_SQL = (
    r"""
    with rows as (
        select doc_id as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
            ['web', 'books', 'forum', 'news'][coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') as int), 0) % 4 + 1] as domain,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens
        from documents),
        leaves as (
            select domain, lang, source, cast(sum(tokens) as bigint) as tokens, cast(sum(tokens) * 2 as bigint) as supply
            from rows group by all),
        root as (
            select cast(least(sum(supply) // 2 * 500 // 1000, sum(supply)) as bigint) as budget from leaves),"""
    + _share_sql("domain", "", "root", _weight_sql("domain"))
    + _share_sql("lang", "domain", "domain_quota", _weight_sql("lang"))
    + _share_sql("source", "domain, lang", "lang_quota", _weight_sql("source"))
    + r"""
        parts as (
            select domain, lang, source, if(tokens > 0, budget // tokens, 0) as whole, if(tokens > 0, budget % tokens, 0) as rest
            from leaves join source_quota using (domain, lang, source)),
        placed as (
            select *, sum(tokens) over (
                partition by domain, lang, source order by md5(concat_ws(':', 42, whole, id)), id, tokens
                rows between unbounded preceding and current row) as upto
            from rows join parts using (domain, lang, source)),
        chosen as (select *, whole + if(upto <= rest, 1, 0) as times from placed where whole + rest > 0)
    select id as doc_id, domain, lang, source, cast(tokens as bigint) as tokens, cast(times as bigint) as times
    from chosen where times > 0"""
)

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
        g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
        from t join g on t.norm = g.norm""",
    "op8_url_filter": r"""
        with p as (
            select page_id, coalesce(url, '') as url, strpos(coalesce(url, ''), '://') as i from pages),
        q as (
            select page_id,
                case when i > 0 then lower(regexp_extract(substr(url, i + 3), '^[^/?#]*')) else '' end as host,
                case when i > 0 then regexp_extract(substr(url, i + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
            from p),
        r(rhost, rpath, v) as (
            values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        f as (
            select q.*, r.rhost || r.rpath as rule, v, row_number() over (
                partition by q.page_id order by length(r.rhost || r.rpath) desc nulls last) as n
            from q left join r on (q.host = r.rhost or ends_with(q.host, '.' || r.rhost)) and starts_with(q.path, r.rpath))
        select page_id, host, path, rule, coalesce(v, 'allow') as verdict from f where n = 1""",
    "op5_topk": r"""
        with v as (
            select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        s as (
            select q.rid, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
            from v q join v c on q.vec_id % 20 = 0 and q.rid <> c.rid and len(q.e) = len(c.e)),
        r as (select *, row_number() over (partition by rid order by score desc, vec_id) as n from s)
        select query_id, cast(n as int) as "rank", vec_id, score from r where n <= 20""",
    "op9_mixing": MIXING_SQL,
}
