"""Language identification as a mixture: EM on n-gram likelihoods, a language set by penalised likelihood.

A language is a distribution over hashed byte trigrams of letters. A document's
trigrams are drawn from a mixture of languages; expectation-maximisation estimates
the proportions, and a language stays in the set only if the likelihood gained by it
exceeds a penalty that grows with the logarithm of the document's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fold_of, slices

#: Hash buckets of trigrams, and the count added to each.
BUCKETS, PRIOR = 1 << 13, 0.5
#: Training documents of a language, about (drawn by hash).
TRAINING_DOCS = 20_000
#: Rounds of EM at most; it has converged when no proportion changes by more. Penalty per language as a multiple of log(trigrams).
ROUNDS, CONVERGED, PENALTY = 50, 1e-3, 4.0

#: Lower-cases A-Z; all else in ASCII that is no letter becomes a space. Other bytes stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the byte trigrams of all words, each between single spaces."""
    low = text if text.isascii() else text.lower()
    raw = b" " + b" ".join(low.encode().translate(LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    h = (h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Languages:
    names: list[str]
    logp: np.ndarray  # buckets x languages

    def mixture(self, p: np.ndarray, counts: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
        """Proportions of the chosen languages and the log-likelihood, relative to ``p``'s scale."""
        q, share = p[:, chosen], np.full(len(chosen), 1 / len(chosen))
        total = counts.sum()
        for _ in range(ROUNDS if len(chosen) > 1 else 0):
            before, share = share, share * (q.T @ (counts / (q @ share))) / total
            if np.abs(share - before).max() < CONVERGED:
                break
        return share, float(counts @ np.log(q @ share))

    def identify(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Main language, its proportion, and the proportions of the chosen set."""
        if not self.names or not has_letter(text):
            return "und", 0.0, {}
        at, counts = trigrams(text)
        if not len(at):
            return "und", 0.0, {}
        logp = self.logp[at].astype(float)
        top = logp.max(axis=1)
        p = np.exp(logp - top[:, None])
        alone = counts @ (logp - top[:, None])
        chosen = [int(np.argmax(alone))]
        share, best = np.ones(1), float(alone[chosen[0]])
        rest = [i for i in np.argsort(-alone).tolist() if i not in chosen]
        price = PENALTY * np.log(1 + counts.sum())
        while rest:
            # EM over all that are left names the next candidate by its proportion
            trial, _ = self.mixture(p, counts, chosen + rest)
            extra = rest[int(np.argmax(trial[len(chosen) :]))]
            new, likely = self.mixture(p, counts, [*chosen, extra])
            if likely - best <= price:
                break
            chosen, share, best = [*chosen, extra], new, likely
            rest.remove(extra)
        order = np.argsort(-share, kind="stable")
        return self.names[chosen[order[0]]], float(share[order[0]]), {self.names[chosen[i]]: float(share[i]) for i in order}


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int, per_language: int) -> Languages:
    """Trigram distributions of the languages of documents not held out.

    About ``per_language`` documents of each are drawn by a hash of the id; every name is
    learned. The driver gets BUCKETS counts for each language at most, however many rows there are.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold_of(id_col, folds) != held))
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Languages([], np.zeros((BUCKETS, 0), np.float32))
    names = sorted(sizes)
    index = {name: i for i, name in enumerate(names)}
    limits = F.create_map(*[F.lit(x) for name in names for x in (name, int((1 << 20) * min(1.0, per_language / sizes[name])))])
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < limits[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(b):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at, n = trigrams(text)
                    total.setdefault(lang, np.zeros(BUCKETS))[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.float64())], names=["lang", "bucket", "n"]
            )

    counted = drawn.mapInArrow(count, "lang string, bucket int, n double")
    table = np.full((BUCKETS, len(names)), PRIOR)
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r.bucket, index[r.lang]] += r.n
    return Languages(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held: int = 2,
    per_language: int = TRAINING_DOCS,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col``, held_out, lang_pred, score, mixture (language -> proportion).

    Learned from the rows with text and language whose crc32(id as text) mod ``folds`` is
    not ``held``; prediction reads the whole text only. Score is the proportion of
    lang_pred. Texts that are null or have no letter, and all texts if nothing could be
    learned, are ``und`` with score 0. Null ids count as held out. Of equally likely
    languages the first by name is taken. Repeated rows are judged each; texts of any
    length are read whole; an empty table gives an empty result. With ``carry`` a column
    ``row`` holds the whole input row; else other columns are not read. Texts go to
    Python, rows do not. The model takes 32 KB a language.
    """
    model = fit(docs, id_col, text_col, lang_col, folds, held, per_language)

    @F.arrow_udf("lang_pred string, score double, mixture map<string, double>")
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = []
            for part in slices(pa.RecordBatch.from_arrays([batch], names=["text"]), text=0):
                found += [model.identify(t) for t in part.column(0).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            mixtures = pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))
            yield pa.StructArray.from_arrays([*columns, mixtures], names=["lang_pred", "score", "mixture"])

    # so that a filter on its result does not run it a second time
    identify = identify.asNondeterministic()
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), identify(F.col(text_col).cast("string")).alias("found"), *whole)
    return rows.select(
        F.col("id").alias(id_col), F.coalesce(fold_of("id", folds) == held, F.lit(True)).alias("held_out"), "found.lang_pred", "found.score",
        "found.mixture", *(["row"] if carry else []),
    )
