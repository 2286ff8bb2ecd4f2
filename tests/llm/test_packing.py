import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skimlight.llm import packing

from .helpers import empty, odd_documents, table


def bins_of(patterns):
    return sum(p.bins for p in patterns)


def check(patterns, counts):
    capacity, used = len(counts) - 1, [0] * len(counts)
    for p in patterns:
        assert p.bins > 0 and sum(s * n for s, n in p.items) <= capacity
        for s, n in p.items:
            used[s] += n * p.bins
    assert used[1:] == counts[1:]


def optimum(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in {x for x in rooms if x >= sizes[i]}:
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(600):
        capacity = rng.choice([10, 20, 30])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        counts = [sizes.count(s) for s in range(capacity + 1)]
        fixed, left = packing.reduce_by_dominance(counts)
        rest = [s for s in range(1, capacity + 1) for _ in range(left[s])]
        assert bins_of(fixed) + optimum(rest, capacity) == optimum(sizes, capacity), sizes
        check(packing.plan_packing(counts), counts)


@pytest.mark.parametrize(
    ("sizes", "fixed"),
    [
        ([5, 3, 2], {(5, 3, 2)}),  # the pair fills the rest better than any one item
        ([6, 4, 2, 2], {(6, 4), (2, 2)}),  # one item fills it exactly
        ([5, 4, 2, 2], {(5, 4), (2, 2)}),  # one item is as large as any pair
        ([11, 6, 5, 4, 2], set()),  # a pair without the largest fits better: left to best fit
    ],
)
def test_reduction_with_two_partners(sizes, fixed):
    capacity = 20 if 11 in sizes else 10
    counts = [sizes.count(s) for s in range(capacity + 1)]
    patterns, left = packing.reduce_by_dominance(counts)
    found = {tuple(s for s, n in p.items for _ in range(n)) for p in patterns}
    assert fixed <= found if fixed else found == set() and left == counts


def best_fit_one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_best_fit_equals_item_by_item():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(0, 200))]
        counts = [sizes.count(s) for s in range(61)]
        patterns = packing.best_fit(counts)
        check(patterns, counts)
        assert bins_of(patterns) == best_fit_one_by_one(sizes, 60)


def test_large_histogram_is_fast_and_tight():
    rng = random.Random(3)
    counts = [0] + [rng.randrange(10**9) for _ in range(700)] + [rng.randrange(10**6) for _ in range(1348)]
    patterns = packing.plan_packing(counts)
    check(patterns, counts)
    assert bins_of(patterns) <= 1.001 * sum(s * n for s, n in enumerate(counts)) / 2048 + 1


def test_places():
    counts = [0, 5, 3, 0, 2]
    places = packing.Places(packing.plan_packing(counts))
    spots = set()
    for size, n in enumerate(counts):
        if n:
            b, o = places.find(np.full(n, size), np.arange(n))
            spots |= {(x, y + i) for x, y in zip(b.tolist(), o.tolist(), strict=True) for i in range(size)}
    assert len(spots) == sum(s * n for s, n in enumerate(counts)) and max(x for x, _ in spots) < places.bins


TEXTS = ["", "  ", "Don't stop, it's 5.6€ «ok» ÀÉßœ ﬁ İI ς Σ", "a\x0bb\x1cc\x85d　e", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "漢字かな 한국어 🙂 é ́x", "a" * 3000, "x'LL've 's 't"]


def test_ids_are_the_tokenizers():
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = packing.WordEncoder(None)
    for t in [*TEXTS, *TEXTS]:
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_small_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    encode, whole = packing.WordEncoder(None), packing.WordEncoder(None)
    for t in TEXTS:
        assert encode([t, "one two three four five"]) == whole([t, "one two three four five"])


@pytest.mark.parametrize("clashing", [False, True])
def test_pieces_cover_documents(spark, clashing):
    rows = odd_documents()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(table(spark, rows, clashing=clashing), capacity=256, with_ids=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(want)
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in group:
            assert r.offset == end
            end += r.length
        assert end <= 256
    assert len({r.sequence_id for r in got}) <= best_fit_one_by_one([r.length for r in got], 256)


def test_empty(spark):
    assert packing.pack_documents(empty(spark)).collect() == []
