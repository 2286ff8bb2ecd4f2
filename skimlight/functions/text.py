"""Text analysis as Column functions: text -> array of (pos, term).

An analyzer is a callable ``Column -> Column`` that gives the terms of a text with
their positions (from 1). Analyzers and filters are found by name in registries that
users may extend; a configuration names one for each field.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import stem

Analyzer = Callable[[Column], Column]
Filter = Callable[[Column], Column]

#: Words of ASCII letters and digits; and words of any letters and digits, with inner dots and apostrophes.
SIMPLE_PATTERN = r"[a-z0-9]+"
STANDARD_PATTERN = r"[\p{L}\p{N}]+(?:[.'’][\p{L}\p{N}]+)*"
CJK_PATTERN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+"
#: Letters that fold to more or other than their base letter (fixed values).
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ŉ": "'n", "ﬁ": "fi", "ﬂ": "fl"}
STROKES = {"ø": "o", "đ": "d", "ł": "l", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n", "ſ": "s", "ĸ": "q"}

#: Quotation marks and dashes (fixed values).
MARKS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "‹": "'", "›": "'", "«": '"', "»": '"'}


def _base_letters() -> dict[str, str]:
    """Lower-case Latin letters with diacritics -> ASCII letter, by canonical decomposition."""
    out = dict(STROKES)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if c == c.lower() and base != c and base.isascii() and base.isalpha():
            out.setdefault(c, base)
    # full-width forms, raised and lowered digits and letters, typographic dashes and quotation marks
    for code in [*range(0xFF01, 0xFF5F), *range(0x2070, 0x209D), 0xB2, 0xB3, 0xB9]:
        base = unicodedata.normalize("NFKD", chr(code)).lower()
        if len(base) == 1 and base.isascii():
            out[chr(code)] = base
    return out | MARKS


BASE_LETTERS = _base_letters()


def fold(text: Column) -> Column:
    """Lower-cased text with Latin diacritics removed and ligatures spelled out."""
    out = F.translate(text, "".join(BASE_LETTERS), "".join(BASE_LETTERS.values()))
    for old, new in LIGATURES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def fold_text(text: str) -> str:
    """``fold`` for a Python string."""
    return text.translate(str.maketrans(BASE_LETTERS | LIGATURES))


def words(text: Column, pattern: str) -> Column:
    """Matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def numbered(terms: Column) -> Column:
    return F.transform(terms, lambda t, i: F.struct((i + 1).cast("int").alias("pos"), t.alias("term")))


def simple(text: Column) -> Column:
    return numbered(words(F.lower(text), SIMPLE_PATTERN))


def standard(text: Column) -> Column:
    """Words of any script, lower-cased and folded; numbers keep inner dots."""
    return numbered(words(fold(F.lower(text)), STANDARD_PATTERN))


def keyword(text: Column) -> Column:
    """The text itself as the only term."""
    return numbered(F.array(text))


def cjk(text: Column) -> Column:
    """Overlapping pairs of characters in runs of Chinese, Japanese or Korean; other words whole."""
    runs = words(F.lower(text), CJK_PATTERN)
    pairs = F.transform(
        runs,
        lambda r: F.when(
            F.regexp_like(r, F.lit(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}$")),
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))),
        ).otherwise(F.array(r)),
    )
    return numbered(F.flatten(pairs))


def without_stop_words(stop: Iterable[str]) -> Filter:
    """Drops terms; the positions of the others stay."""
    stop = list(stop)
    return lambda terms: F.filter(terms, lambda t: ~t["term"].isin(stop)) if stop else terms


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(lambda ts: [stem(t) for t in ts])


def stemmed(terms: Column) -> Column:
    """English stems. No built-in function stems, so this is an Arrow UDF; it runs when an index is built."""
    stems = _stems(F.transform(terms, lambda t: t["term"]))
    return F.zip_with(terms, stems, lambda t, s: F.struct(t["pos"].alias("pos"), s.alias("term")))


def truncated(n: int) -> Filter:
    return lambda terms: F.transform(terms, lambda t: F.struct(t["pos"].alias("pos"), F.substring(t["term"], 1, n).alias("term")))


#: name -> function of the configuration.
ANALYZERS: dict[str, Callable[[Mapping], Analyzer]] = {
    "simple": lambda config: simple,
    "standard": lambda config: standard,
    "keyword": lambda config: keyword,
    "cjk": lambda config: cjk,
}
FILTERS: dict[str, Callable[[Mapping], Filter]] = {
    "stop": lambda config: without_stop_words(config.get("stopwords", [])),
    "stem": lambda config: stemmed,
    "truncate": lambda config: truncated(int(config["length"])),
}


def register_analyzer(name: str, factory: Callable[[Mapping], Analyzer]) -> None:
    ANALYZERS[name] = factory


def register_filter(name: str, factory: Callable[[Mapping], Filter]) -> None:
    FILTERS[name] = factory


def analyzer(config: Mapping | str | None = None) -> Analyzer:
    """From {"analyzer": name, ..., "filters": [{"filter": name, ...}]}; a "stopwords" list is a filter too."""
    config = {"analyzer": config} if isinstance(config, str) else dict(config or {})
    base = ANALYZERS[config.get("analyzer", "standard")](config)
    chain = [FILTERS[f["filter"]](f) for f in config.get("filters", [])]
    if config.get("stopwords"):
        chain.insert(0, without_stop_words(config["stopwords"]))

    def run(text: Column) -> Column:
        terms = base(text)
        for step in chain:
            terms = step(terms)
        return terms

    return run


def analyzers(config: Mapping | None = None) -> Callable[[str], Analyzer]:
    """Field name -> analyzer, from {"perField": {field: config}, "default": config}."""
    config = config or {}
    own = {f: analyzer(c) for f, c in config.get("perField", {}).items()}
    rest = analyzer(config.get("default"))
    return lambda field: own.get(field, rest)


_PYTHON_WORD = {
    "simple": re.compile(r"[a-z0-9]+"),
    "standard": re.compile(r"[^\W_]+(?:[.'’][^\W_]+)*"),
    "keyword": re.compile(r".+", re.S),
}


def spans(text: str, kind: str = "standard") -> list[tuple[str, int, int]]:
    """(term, start, end) of a Python string: for query strings and for the few texts shown as snippets."""
    if kind == "simple":
        return [(m.group(), *m.span()) for m in _PYTHON_WORD[kind].finditer(text.lower())]
    if kind == "keyword":
        return [(text, 0, len(text))] if text else []
    return [(fold_text(m.group().lower()), *m.span()) for m in _PYTHON_WORD[kind].finditer(text)]
