"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Item sizes are whole numbers up to the capacity, so an instance of any size is a
histogram of at most ``capacity`` counts. The reduction and the best-fit pass work
on that histogram and give patterns (which sizes share a sequence, and how many
times); tasks then find the place of each piece from its rank among the pieces of
its size. Only the histogram and the patterns are on the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise, prefix_sums, slices, worker_state

#: Words whose ids a Python worker keeps: about 40 MB.
CACHED_WORDS = 200_000


@dataclass(frozen=True)
class Pattern:
    """``bins`` sequences that each hold ``items``: (size, how many) in order."""

    bins: int
    items: tuple[tuple[int, int], ...]


def reduce_by_dominance(counts: list[int]) -> tuple[list[Pattern], list[int]]:
    """Patterns that some optimal packing contains, and the counts that remain.

    ``counts[s]``: items of size s; the capacity is ``len(counts) - 1``. For the
    largest items first, a set with item j dominates all other sets with j when
    - nothing else fits beside j: j alone;
    - an item k fills the rest exactly: j with k;
    - no two items fit in the rest together: j with the largest k that fits;
    - no three fit, and k, the largest that fits, is at least as large as the fullest
      pair: j with k;
    - no three fit, k is part of the fullest pair, and no pair of items larger than its
      partner fits: j with this pair.
    """
    left, capacity, fixed = list(counts), len(counts) - 1, []

    def fix(n: int, *sizes: int) -> None:
        for s in sizes:
            left[s] -= n
        items = tuple((s, sizes.count(s)) for s in dict.fromkeys(sizes))
        fixed.append(Pattern(n, items))

    for j in range(capacity, 0, -1):
        while left[j]:
            chosen = _dominant(left, j, capacity)
            if chosen is None:
                break
            used = Counter((j, *chosen))
            fix(min(left[s] // n for s, n in used.items()), j, *chosen)
    return fixed, left


def _dominant(left: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside an item of size j, if some set with it dominates all others."""
    room = capacity - j
    own = lambda s: left[s] - (s == j)  # noqa: E731 those beside the item itself
    fits = [s for s in range(1, room + 1) if own(s)]
    if not fits:
        return ()
    k = fits[-1]
    small = [s for s in fits[:3] for _ in range(min(3, own(s)))][:3]
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return (k,)
    if len(small) == 3 and sum(small) <= room:
        return None
    # two at most fit beside j: the fullest pair, of these the one with the largest item
    pair, high = (0, 0, 0), len(fits) - 1
    for b in fits:
        while high >= 0 and fits[high] + b > room:
            high -= 1
        at = high
        while at >= 0 and fits[at] >= b and own(fits[at]) < 1 + (fits[at] == b):
            at -= 1
        if at >= 0 and fits[at] >= b:
            pair = max(pair, (fits[at] + b, fits[at], b))
    full, a, b = pair
    if k >= full:
        return (k,)
    larger = [s for s in fits if s > b]
    two = [s for s in larger[:2] for _ in range(min(2, own(s)))][:2]
    if a == k and (len(two) < 2 or sum(two) > room):
        return (a, b)
    return None


def best_fit(counts: list[int]) -> list[Pattern]:
    """Best-fit decreasing, all items of a size and all sequences of a pattern at a time."""
    capacity = len(counts) - 1
    open_: list[list[Pattern]] = [[] for _ in range(capacity + 1)]  # by room
    for size in range(capacity, 0, -1):
        n, room = counts[size], size
        while n:
            while room <= capacity and not open_[room]:
                room += 1
            if room > capacity:
                open_[capacity].append(Pattern(n, ()))
                room = capacity
            p = open_[room].pop()
            each = min(room // size, n)
            used = min(p.bins, n // each)
            if used < p.bins:
                open_[room].append(Pattern(p.bins - used, p.items))
            open_[room - each * size].append(Pattern(used, (*p.items, (size, each))))
            n -= each * used
        # sequences opened for the last few items may be left empty
        open_[capacity] = []
    return [p for group in open_ for p in group]


def plan_packing(counts: list[int]) -> list[Pattern]:
    fixed, left = reduce_by_dominance(counts)
    return fixed + best_fit(left)


class Places:
    """Sequence and offset of the piece of a given size and rank (from 0) in that size."""

    SHIFT = 44  # ranks below 2 ** 44

    def __init__(self, patterns: Iterable[Pattern]):
        rows, used, first = [], {}, 0
        for p in patterns:
            offset = 0
            for size, each in p.items:
                rank = used.get(size, 0)
                used[size] = rank + p.bins * each
                rows.append(((size << self.SHIFT) + rank, each, first, offset, size))
                offset += size * each
            first += p.bins
        self.bins = first
        self.start, self.each, self.first, self.offset, self.size = np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (size.astype(np.int64) << self.SHIFT) + rank
        at = np.searchsorted(self.start, key, side="right") - 1
        back = key - self.start[at]
        return self.first[at] + back // self.each[at], self.offset[at] + back % self.each[at] * self.size[at]


#: Texts of these characters split into the vocabulary's words by PARTS, lower-cased; others are left to the library.
PLAIN = re.compile(r"[\t-\r\x20-~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Texts -> ids as little-endian unsigned 32-bit numbers, as bytes.

    The vocabulary is lower case, drops white space and merges inside words only, so ids
    are looked up word by word, and the new words of many texts are encoded together. The
    number of words kept is bounded by CACHED_WORDS.
    """

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Each is one word for the vocabulary: its last id is the only one that ends a word."""
        groups = [new[i : i + 2000] for i in range(0, len(new), 2000)]
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(group):  # not such a vocabulary
                self.known.update((w, self._alone(w)) for w in group)
                continue
            raw = ids.tobytes()
            self.known.update((w, raw[lo:hi]) for w, lo, hi in zip(group, [0, *cuts], cuts, strict=False))

    def _alone(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parts: list[list[str] | None] = []
        for t in texts:
            # strings of special tokens are looked for in the text as it is
            plain = not t or (PLAIN.fullmatch(t) and "<|" not in t)
            parts.append(PARTS.findall(t.lower()) if t and plain else [] if plain else None)
        every = set().union(*(p for p in parts if p))
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        self._learn(list(every.difference(self.known)))
        ids = self.known.__getitem__
        return [b"".join(map(ids, p)) if p is not None else self._alone(t) for p, t in zip(parts, texts, strict=True)]


def word_encoder(path: str | None) -> WordEncoder:
    """The worker's encoder for this vocabulary."""
    state = worker_state()
    if ("words", path) not in state:
        state["words", path] = WordEncoder(path)
    return state["words", path]


def token_pieces(
    docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str | None, end_id: int, with_ids: bool
) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids: a row per piece of a document."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                which, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, b in enumerate(encode(part.column(1).to_pylist())):
                    b += tail
                    for j, at in enumerate(range(0, len(b), 4 * capacity)):
                        cut = b[at : at + 4 * capacity]
                        which.append(i), piece.append(j), start.append(at // 4), length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                columns = {
                    "id": part.column(0).take(pa.array(which, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's ids are those of ``tokenizer`` (a file on the executors; None: the
    public word vocabulary) and then ``end_id``; only documents longer than ``capacity``
    are cut. Null and empty texts are ``end_id`` alone. Repeated rows are packed each. An
    empty table gives an empty result; other columns are not read. Pieces of a sequence
    have offsets without gaps from 0.
    """
    pieces = materialise(token_pieces(docs, id_col, text_col, capacity, tokenizer, end_id, with_ids), "pieces")
    counts = [0] * (capacity + 1)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[row.length] = row.n
    places = Places(plan_packing(counts))

    def run(batches):
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"]
            )

    place = F.md5(F.concat_ws(":", "id", "piece", "ids_crc32"))
    ranked = prefix_sums(
        pieces.drop("ids").withColumns({"place": place, "one": F.lit(1)}), ["length"], "place", "one", ["id", "piece", "start"]
    )
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("upto") - 1).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    if with_ids:
        ids = pieces.select("id", "piece", "ids_crc32", "ids").dropDuplicates(["id", "piece", "ids_crc32"]).toDF("i", "p", "c", "ids")
        out = out.join(ids, F.expr("id <=> i and piece = p and ids_crc32 = c")).drop("i", "p", "c")
    return out.withColumnRenamed("id", id_col)
