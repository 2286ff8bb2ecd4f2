"""Snippets with highlighted matches, for the few documents of a page."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from html.entities import codepoint2name

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import spans

#: Characters from the first to the last match of a window, and terms of context before and after.
WINDOW, BEFORE, AFTER = 200, 5, 24


def escape(text: str) -> str:
    """HTML 4 entities; other characters beyond ASCII by number."""
    return "".join(
        f"&{codepoint2name[c]};" if (c := ord(x)) in codepoint2name else f"&#{c};" if c > 0x7F else x for x in text
    )


def _is_match(term: str, wanted: Iterable[str]) -> bool:
    return any(term.startswith(w[:-1]) if w.endswith("*") else term == w for w in wanted)


def snippet(text: str, wanted: set[str], kind: str = "html") -> str:
    """The window with most matches (times the square of different ones), matches in bold; empty without a match."""
    if kind not in ("html", "lines"):
        raise ValueError(f"unknown snippet type {kind}")
    terms = spans(text)
    hits = [i for i, (t, _, _) in enumerate(terms) if _is_match(t, wanted)]
    best: list[int] = []
    most, left = 0, 0
    for right in range(len(hits)):
        while left < right and terms[hits[right]][2] - terms[hits[left]][1] > WINDOW:
            left += 1
        window = hits[left : right + 1]
        score = len(window) * len({terms[i][0] for i in window}) ** 2
        if score > most:
            most, best = score, window
    if not best:
        return ""
    at = terms[max(0, best[0] - BEFORE)][1]
    end = terms[min(best[-1] + AFTER, len(terms) - 1)][2]
    if kind == "lines":
        at = text.rfind("\n", 0, at) + 1
        line = text.find("\n", end)
        end = len(text) if line < 0 else line + 1
    elif at and text[at - 1] == "&":
        at -= 1
    out = []
    for i in best:
        _, s, e = terms[i]
        out += [escape(text[at:s]), "<b>", escape(text[s:e]), "</b>"]
        at = e
    return "".join([*out, escape(text[at:end])])


def snippet_column(wanted: set[str], kind: str = "html") -> Callable[[Column], Column]:
    """``snippet`` as a Column function."""
    if kind not in ("html", "lines"):
        raise ValueError(f"unknown snippet type {kind}")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", wanted, kind))

    return run
