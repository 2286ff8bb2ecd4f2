import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimlight.llm import url_filter
from skimlight.llm.queries import RULES

from .helpers import CLASHING


def brute(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?q=/fr/#z", "http://example.net", "http://example.net/", "http://net/en/", "http://xnet/", "a://b://c.net/",
    "http://org/fr/1", "http://www.org/fr", "http://www.example.com/de/?x", "http://example.com?/de/", "http://example.com#/de/", "http://é.example.com/de/é", "http://..net//",
    "http://x.net/\n/y", "http://" + "a." * 500 + "net/" + "p/" * 500,
]


def judge(spark, urls, rules, clashing=False):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    if clashing:
        pages = pages.withColumns({c: F.lit(1) for c in CLASHING})
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, df).collect()}


@pytest.mark.parametrize("clashing", [False, True])
def test_contract_rules(spark, clashing):
    assert judge(spark, URLS, RULES, clashing) == {i: brute(u, RULES) for i, u in enumerate(URLS)}


def test_many_rules(spark):
    rng = random.Random(1)
    hosts = [".".join(rng.choices(["a", "b", "c", "com"], k=rng.randrange(1, 4))) for _ in range(60)]
    paths = ["", "/", "/x", "/x/", "/x/y", "/z/"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)): (rng.choice(["block", "allow"])) for _ in range(200)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{rng.choice(['', 'w.', 'b.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y/z', '/xx', '/z/1?/x'])}" for _ in range(300)]
    assert judge(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_repeats_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    assert sorted((str(r.page_id), r.verdict) for r in url_filter.judge_urls(pages, rules).collect()) == [("1", "block"), ("1", "block"), ("None", "allow")]
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("key"), "id").alias("key"))
    words = url_filter.build_filter(keys)

    def passes(df):
        h = np.array([r[0] for r in df.select(F.xxhash64("key")).collect()], np.int64)
        block, mask = url_filter._bits(h, len(words))
        return ((words[block] & mask) == mask).mean()

    assert passes(keys) == 1 and passes(spark.range(5000).select(F.concat(F.lit("other"), "id").alias("key"))) < 0.02
