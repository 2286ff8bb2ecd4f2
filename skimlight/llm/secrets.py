"""Secret scan: fixed patterns, and zstandard novelty in sensitive context.

A candidate is a string of letters and digits near a sensitive word, before or after
it. It is compressed after its surroundings, with dictionaries of code and of the
identifiers of the corpus primed: the bytes it adds, per byte of its own, are its
novelty. Names, paths and words are cheap after the dictionaries and the text around
them; random strings cost what they weigh. An identifier is a candidate that stands
in several different surroundings anywhere in the corpus; a secret that a copied
document repeats stands in one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise, slices

#: The base patterns, and the least length of what each must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as a shorter run has no match inside
LEAST = {"assign": 12, "access": 18}
KINDS = ["assign", "access", "hex", "novel"]

#: Strings that may be secrets (no dot or equals sign of a sentence or assignment), and the words that make their surroundings sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-](?:[A-Za-z0-9+/_.~-]*[A-Za-z0-9+/_-])?={0,2}")
SENSITIVE = re.compile(r"pass|secret|token|key|auth|bearer|credential|private|login|cookie|session|signature|jwt|pwd", re.I | re.A)

#: Code and identifiers that compress well afterwards.
DICTIONARY = b"""
import os sys json logging requests; from typing import Any; def __init__(self, config): return None
public static final String private void protected class interface extends implements package function const let var
if (response.status_code == 200) { result = data.get("value"); } else { throw new IllegalArgumentException("invalid"); }
application/json content-type authorization: bearer access_token refresh_token client_id client_secret redirect_uri
username password passwd api_key apikey secret_key private_key public_key session_id user_agent example.com localhost
getElementById addEventListener createElement configuration environment production development database connection
http://www. https:// /usr/local/bin /home/user/ abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
lorem ipsum dolor sit amet the of and to in is that for with as was on are this be by from or not have which
"""


#: Where a known string begins in it.
KNOWN = DICTIONARY.index(b"abcdefghij")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Bytes a string adds to its compressed surroundings beyond what a known string of its length adds, per byte."""

    def __init__(self, identifiers: bytes = b""):
        import zstandard

        # what stands last is nearest
        raw = zstandard.ZstdCompressionDict(identifiers + DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = lambda b, c=zstandard.ZstdCompressor(level=9, dict_data=raw, write_checksum=False): len(c.compress(b))

    def __call__(self, around: str, candidate: str) -> float:
        # a known line first, so that short surroundings are compressed, too
        before, own = DICTIONARY[:64] + around.encode("utf-8", "surrogatepass") + b"\n", candidate.encode()
        known = (b" " + DICTIONARY[KNOWN:])[: len(own)]
        return (self.size(before + own) - self.size(before + known)) / len(own)


def candidates(text: str, taken: list[tuple[int, int, int]], least: int, near: int) -> list[tuple[int, int]]:
    """Strings of ``least`` characters or more with letters and digits, a sensitive word within ``near`` characters of either end, that touch no base span and are no part of a URL."""
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    spans = sorted((s, e) for s, _, e in taken)
    out, seen, at = [], 0, 0
    # only the text around sensitive words is looked at; runs of them together, so that it stays linear
    zones: list[list[int]] = []
    for s, e in words:
        lo, hi = max(0, s - near), min(len(text), e + near)
        if zones and lo <= zones[-1][1]:
            zones[-1][1] = hi
        else:
            zones.append([lo, hi])
    for lo, hi in zones:
        while lo > seen and _joins(text[lo - 1]):  # whole strings at the ends
            lo -= 1
        for m in CANDIDATE.finditer(text, max(lo, seen)):
            s, e = m.span()
            if s >= hi:
                break
            seen = max(seen, e)
            own = m.group()
            if e - s < least or not (any(c.isdigit() for c in own) and any(c.isalpha() for c in own)):
                continue
            if text.find("://", max(0, s - 8), e) >= 0 or "//" in own:
                continue
            # a word in the string itself does not count
            if not (SENSITIVE.search(text, max(0, s - near), s) or SENSITIVE.search(text, e, e + near)):
                continue
            while at < len(spans) and spans[at][1] <= s:
                at += 1
            if at < len(spans) and spans[at][0] < e:
                continue
            out.append((s, e))
    return out


def _joins(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "+/_.=~-")


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "array<struct<start: long, stop: long, own: string, around: string, context: long>>"


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_novelty: float = 0.7,
    least_length: int = 12,
    near: int = 64,
    around: int = 256,
    contexts: int = 3,
    dictionary_bytes: int = 64 << 10,
) -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex, base (spans), spans (all spans).

    Spans are kind:start:end by start, then in the order of KINDS, comma-joined; offsets
    are code points, end exclusive. Base spans are those of the fixed patterns. A ``novel``
    span is a string of ``least_length`` characters or more with letters and digits, with a
    sensitive word at most ``near`` characters before or after it, that adds ``least_novelty``
    bytes per byte, beyond a known string, to up to ``around`` characters on each side of it. Strings that stand in
    ``contexts`` or more different surroundings are the corpus' identifiers; the most common
    of them, up to ``dictionary_bytes``, are primed (ties to the string in order).

    The whole text is scanned; null counts as empty and has no spans. Repeated rows are
    scanned each; empty tables give empty results; other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("own", pa.string()), ("around", pa.string()), ("context", pa.int64())]))
        for batch in (part for whole in batches for part in slices(whole)):
            counts, base, found = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in spans))
                base.append(join_spans(spans))
                rows = []
                for s, e in candidates(text, spans, least_length, near):
                    before, after = text[max(0, s - around) : s], text[e : e + around]
                    context = zlib.crc32((before[-32:] + "\n" + after[:32]).encode("utf-8", "surrogatepass"))
                    rows.append({"start": s, "stop": e, "own": text[s:e], "around": before + after, "context": context})
                found.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(found, kind)],
                names=["id", "n_assign", "n_access", "n_hex", "base", "found"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = f"id {kind}, n_assign long, n_access long, n_hex long, base string"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"{counted}, found {FOUND}")
    rows = materialise(rows, "candidates")
    strings = rows.select(F.explode("found").alias("f")).select("f.own", "f.context").groupBy("own", "context").agg(F.lit(1).alias("one")).groupBy("own").agg(F.count("one").alias("n"))
    most = dictionary_bytes // least_length
    common = strings.where(F.col("n") >= contexts).orderBy(F.desc("n"), "own").limit(most).collect()  # as many as the dictionary can hold
    primed, size = [], 0
    for r in common:
        size += len(r.own) + 1
        if size <= dictionary_bytes:
            primed.append(r.own)
    identifiers = "\n".join(reversed(primed)).encode()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            spans = []
            for base, found in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                every = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                every += [(f["start"], 3, f["stop"]) for f in found if novelty(f["around"], f["own"]) >= least_novelty]
                spans.append(join_spans(sorted(every)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return rows.mapInArrow(measure, f"{counted}, spans string").withColumnRenamed("id", id_col)
