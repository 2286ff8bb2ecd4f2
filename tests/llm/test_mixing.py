import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skimlight.llm import mixing
from skimlight.llm.queries import WEIGHTS, domain_of

from .helpers import empty, odd_documents, table


def share(supply, weight, budget):
    """Pour the budget over the children; the full ones leave, the rest share again."""
    quota, names, money = {}, sorted(supply, key=lambda n: (supply[n] / weight[n], n)), budget
    while names:
        rest = sum(weight[n] for n in names)
        n = names[0]
        if supply[n] * rest > weight[n] * money:
            return quota | {n: weight[n] * money // rest for n in names}
        quota[n] = supply[n]
        money -= supply[names.pop(0)]
    return quota


#: Names of the ids where they are not themselves.
ORDER = {}


def brute(rows, permille, epochs, seed=42):
    docs = []
    texts = {}
    for i, text, lang, source, _ in rows:
        digits = "".join(c for c in (source or "")[-9:] if c.isdigit()) if (source or "")[-1:].isdigit() else ""
        domain = ["web", "books", "forum", "news"][int(digits or 0) % 4]
        texts[len(docs)] = hashlib.md5((text or "").encode()).hexdigest()
        docs.append((i, domain, lang or "", source or "", len((text or "").split(None)) if (text or "").isascii() else len((text or "").split())))
    leaves = defaultdict(int)
    for _, d, lang, s, n in docs:
        leaves[d, lang, s] += n
    total = sum(leaves.values())
    quota = {(): min(total * permille // 1000, total * epochs)}
    for level in range(3):
        name, new = mixing.LEVELS[level], {}
        for parent in quota:
            kids = defaultdict(int)
            for leaf, n in leaves.items():
                if leaf[:level] == parent:
                    kids[leaf[level]] += n * epochs
            weight = {k: WEIGHTS.get(name, {}).get(k, 1) for k in kids}
            new |= {(*parent, k): q for k, q in share(kids, weight, quota[parent]).items()}
        quota = new
    out = []
    for leaf, q in quota.items():
        n = leaves[leaf]
        whole, left = divmod(q, n) if n else (0, 0)
        own = [(d, texts[k]) for k, d in enumerate(docs) if tuple(d[1:4]) == leaf]
        md5 = lambda d, t: hashlib.md5(f"{seed}:{whole}:{ORDER.get(d[0], t if d[0] is None else d[0])}".encode()).hexdigest()
        upto = 0
        for d, _ in sorted(own, key=lambda x: (md5(*x), x[0][0] is not None, x[0][0] or 0, x[0][4])):
            upto += d[4]
            times = whole + (upto <= left)
            if times and whole + left:
                out.append((*d, times))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("permille", "epochs"), [(500, 2), (0, 1), (1000, 1), (1700, 2), (100, 3), (9999, 2)])
def test_brute(spark, permille, epochs):
    rows = odd_documents()
    got = mixing.mix_sources(table(spark, rows, clashing=True), domain_of("source"), WEIGHTS, budget_permille=permille, epochs=epochs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, permille, epochs)


def test_products_beyond_a_long(spark):
    """Tokens times weights exceed 64 bits; shares stay exact."""
    supply = {"a": 5 * 10**14, "b": 3 * 10**15, "c": 9 * 10**15 + 7}
    weight = {"a": 200_000, "b": 100_001, "c": 70_003}
    rows = [(n, supply[n], weight[n], 6 * 10**15) for n in supply]
    got = mixing.share_out(spark.createDataFrame(rows, "name string, supply long, weight long, budget long"), [], "name").collect()
    assert {r.name: r.quota for r in got} == share(supply, weight, 6 * 10**15)


def test_shortage_goes_to_siblings_first(spark):
    supply = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("news", "en", "d", 5)]
    df = spark.createDataFrame(supply, "domain string, lang string, source string, tokens long")
    got = {r.source: r.quota for r in mixing.leaf_quotas(df, 400, {}, {}, 1).collect()}
    # news has 5 of its 200; web's 395 are 197 for each language, and b takes what a lacks
    assert got == {"a": 10, "b": 187, "c": 197, "d": 5}


def test_random_trees(spark):
    rng = random.Random(5)
    for _ in range(5):
        supply = {n: rng.randrange(0, 50) for n in "abcdefg"}
        weight = {n: rng.randrange(1, 6) for n in supply}
        budget = rng.randrange(0, sum(supply.values()) + 1)
        kids = spark.createDataFrame([(1, n, supply[n], weight[n], budget) for n in supply], "p int, n string, supply long, weight long, budget long")
        assert {r.n: r.quota for r in mixing.share_out(kids, ["p"], "n").collect()} == share(supply, weight, budget)


def test_zero_weight_and_empty(spark):
    rows = [(i, "a b c", "en", "src0", 0) for i in range(10)]
    mix = lambda df, **k: mixing.mix_sources(df, domain_of("source"), {"lang": {"en": 0}}, **k).collect()
    assert mix(table(spark, rows)) == [] and mix(empty(spark)) == []
    assert len(mixing.mix_sources(table(spark, rows), F.lit("d"), {}, budget_tokens=10).collect()) == 3
