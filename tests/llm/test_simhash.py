import random
import re

import pytest
import xxhash

from skimlight.llm import simhash
from skimlight.llm.components import connected_components

from .helpers import empty, odd_documents, table, words


def brute_fp(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("clashing", [False, True])
def test_groups_against_all_pairs(spark, clashing):
    rows = odd_documents()
    got = simhash.simhash_groups(table(spark, rows, clashing=clashing), words=3).collect()
    fps = [brute_fp(t, 3) for _, t, *_ in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for (i, *_), f in zip(rows, fps, strict=True))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    part = components(range(len(rows)), links)
    low = {}
    for i, c in part.items():
        if rows[i][0] is not None:
            low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    want = sorted((str(rows[i][0]), low.get(c), sum(x == c for x in part.values())) for i, c in part.items())
    assert sorted((str(r.doc_id), r.component_id, r.group_size) for r in got) == want


@pytest.mark.parametrize("pairwise", [0, 3, 1000])
@pytest.mark.parametrize(("blocks", "distance"), [(4, 2), (3, 2), (6, 2), (3, 1), (2, 0)])
def test_links_are_complete_and_true(spark, monkeypatch, pairwise, blocks, distance):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:10]:
        fps += [f ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)) for _ in range(5)]
    for f in fps[10:14]:  # chains, each link one bit
        fps += [f ^ 2, f ^ 6, f ^ 14]
    fps = sorted({simhash._signed(f) for f in fps})
    links = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance]
    got = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), blocks, distance).collect()]
    assert set(got) <= set(links)
    assert components(fps, got) == components(fps, links)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates(spark):
    rng = random.Random(8)
    passage = words(rng, 60)
    rows, near, far = [], [], []
    for i in range(60):
        n = rng.choice([40, 120, 400, 1500])
        text = words(rng, n).split()
        own = " ".join(text[: n // 2] + passage.split() + text[n // 2 :])  # a passage that all share
        copy = own.split()
        for _ in range(rng.randrange(1, max(3, n // 15))):
            copy[rng.randrange(len(copy))] = "changed" + str(rng.random())
        copy = " ".join(copy)
        rows += [(2 * i, own, "en", "s", 0), (2 * i + 1, copy, "en", "s", 0)]
        j = jaccard(own, copy)
        (near if j >= 0.84 else far if j < 0.76 else []).append(2 * i + 1)
    assert len(near) > 20 and len(far) > 5
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert sum(got[d] == d - 1 for d in near) >= 0.97 * len(near)
    assert all(got[d] == d for d in far) and all(got[2 * i] == 2 * i for i in range(60))


def test_near_duplicates_odd_cases(spark):
    rows = odd_documents()
    got = simhash.near_duplicates(table(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    blank = {i for i, t, *_ in rows if i is not None and not (t or "").split()}
    assert len({by[i] for i in blank}) == 1 and by[12] == by[13] == 0 and by[14] == 1 and by[3] == 3
    assert simhash.near_duplicates(empty(spark)).collect() == [] and simhash.simhash_groups(empty(spark)).collect() == []


@pytest.mark.parametrize(("block", "tile", "drawn"), [(32, 256, 1024), (4, 20, 64)])
def test_near_duplicates_in_a_family_of_variants(spark, monkeypatch, block, tile, drawn):
    """Hundreds of variants of one text, most of them strangers: a section's centre is seldom like a member's partner."""
    for name, value in (("BLOCK", block), ("TILE", tile), ("DRAWN", drawn)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)
    base = words(rng, 204).split()
    texts = []
    for edits in [5] * 300 + [1] * 10:
        variant = list(base)
        for at in rng.sample(range(len(base)), edits):
            variant[at] = f"new{rng.random()}"
        texts.append(" ".join(variant))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = components(range(len(texts)), links)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert len(links) > 60 and all(want[i] == want[got[i]] for i in got)
    assert sum(got[i] != got[j] for i, j in links) <= 0.02 * len(links)


def test_near_duplicates_of_small_sets_are_exact(spark):
    """Pairs with 4 of 5 shingles in common are linked, pairs with 7 of 9 are not: small sets leave the angle formula."""
    rng = random.Random(6)
    rows = []
    for i in range(80):
        text = words(rng, 8)
        rows += [(4 * i, text, "en", "s", 0), (4 * i + 1, f"{text} more{i}", "en", "s", 0)]
        text = words(rng, 12)
        rows += [(4 * i + 2, text, "en", "s", 0), (4 * i + 3, " ".join([*text.split()[:11], f"other{i}"]), "en", "s", 0)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    met = sum(got[4 * i + 1] == 4 * i for i in range(80))
    assert met >= 76 and all(got[4 * i + 3] == 4 * i + 3 for i in range(80))


def test_recall_at_the_threshold(spark):
    """200 pairs at a similarity of exactly 0.8 for each size of sets, among them such with a long passage that all share."""
    rng = random.Random(10)
    passage = words(rng, 120)
    rows, pairs = [], []
    for few, many in ((4, 5), (8, 10), (12, 15), (40, 50), (400, 500), (0, 0)):
        for i in range(200):
            new = lambda n: [f"{rng.randrange(10**9):x}" for _ in range(n)]
            if many:
                text = new(few + 4)
                other = text + new(many - few)
            else:  # 300 shingles of which 60 are the other's own: the rest, and the passage, are common
                own = new(184)
                text, other = [*passage.split(), *own], [*passage.split(), *own, *new(75)]
            at = len(rows)
            rows += [(at, " ".join(text), "en", "s", 0), (at + 1, " ".join(other), "en", "s", 0)]
            assert jaccard(rows[at][1], rows[at + 1][1]) >= 0.7999999
            pairs.append((few, many, at))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    for size in {p[:2] for p in pairs}:
        own = [at for *s, at in pairs if tuple(s) == size]
        assert sum(got[at] == got[at + 1] for at in own) >= 0.99 * len(own), size
    assert len({got[at] for *_, at in pairs}) == len(pairs)  # the passage alone links none
