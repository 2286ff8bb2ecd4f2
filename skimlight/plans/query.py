"""Query trees: terms, prefixes, phrases and their Boolean combinations.

Each node has a boost. Scores add up: a conjunction or disjunction scores the sum of
its sides times their boosts, a difference its left side; the tree's norm is the sum
of boosts on the way, so that the root's score divided by it is comparable.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from ..functions.text import spans


class InvalidQuery(ValueError):
    """The query string is not valid or asks for something that is not supported."""


@dataclass(frozen=True)
class Node:
    boost: float = field(default=1.0, kw_only=True)

    @property
    def norm(self) -> float:
        return 1.0

    def children(self) -> tuple[Node, ...]:
        return ()

    def leaves(self) -> Iterator[Node]:
        for c in self.children():
            yield from c.leaves()
        if not self.children():
            yield self

    def positive_terms(self) -> set[tuple[str, str]]:
        """(field, term) to highlight; a prefix counts as ``prefix*``."""
        return set().union(*(c.positive_terms() for c in self.children()))

    def boosted(self, by: float) -> Node:
        return replace(self, boost=self.boost * by)


@dataclass(frozen=True)
class Term(Node):
    field: str
    term: str

    def positive_terms(self):
        return {(self.field, self.term)}


@dataclass(frozen=True)
class Prefix(Node):
    field: str
    prefix: str

    def positive_terms(self):
        return {(self.field, self.prefix + "*")}


@dataclass(frozen=True)
class Phrase(Node):
    field: str
    terms: tuple[str, ...]
    positions: tuple[int, ...]

    def positive_terms(self):
        return {(self.field, t) for t in self.terms}


@dataclass(frozen=True)
class MatchAll(Node):
    """Every document, with score 1."""


@dataclass(frozen=True)
class TermRange(Node):
    """Can be named but not run."""

    field: str
    low: str
    high: str


@dataclass(frozen=True)
class Pair(Node):
    left: Node
    right: Node

    def children(self):
        return self.left, self.right

    @property
    def norm(self) -> float:
        return self.left.boost * self.left.norm + self.right.boost * self.right.norm


class _Commutes:
    def __eq__(self, other: object) -> bool:
        if type(self) is not type(other) or self.boost != other.boost:
            return False
        return (self.left, self.right) in ((other.left, other.right), (other.right, other.left))

    def __hash__(self) -> int:
        return hash((type(self), self.boost, frozenset((self.left, self.right))))


@dataclass(frozen=True, eq=False)
class And(_Commutes, Pair):
    pass


@dataclass(frozen=True, eq=False)
class Or(_Commutes, Pair):
    pass


@dataclass(frozen=True)
class Difference(Pair):
    """Left and not right."""

    @property
    def norm(self) -> float:
        return self.left.boost * self.left.norm

    def positive_terms(self):
        return self.left.positive_terms()


_TOKEN = re.compile(
    r"""\s*(?:(?P<op>\(|\)|\+|-|!(?!=)|&&|\|\||(?:AND|OR|NOT)(?![^\s()]))|(?P<field>(?:\\.|[^\s+\-!():^\[\]"{}~*?\\]|(?<=\S)[+\-])+):"""
    r"""|"(?P<phrase>(?:\\.|[^"\\])*)"(?:~(?P<slop>\d+))?|(?P<term>(?:\\.|[^\s!():^\[\]"{}~\\])(?:\\.|[^\s():^\[\]"{}~\\])*)|(?P<boost>\^\d+(?:\.\d+)?)|(?P<bad>\S))"""
)


def parse(text: str, default_field: str = "text", analyze: Callable[[str, str], list[tuple[str, int]]] | None = None) -> Node:
    """A query string -> tree. Clauses are joined by AND unless OR stands between them.

    Terms, ``"phrases"``, ``prefix*``, ``field:``, ``^boost``, ``+`` ``-`` ``NOT`` and
    parentheses. ``analyze(field, text)`` gives the (term, position) pairs of a word or
    phrase; one word of several terms is a phrase. Slop is ignored. Positive clauses fold
    to the right, and the second of two decides whether they are joined by AND or OR.
    """
    analyze = analyze or (lambda f, t: [(term, i) for i, (term, _, _) in enumerate(spans(t, "standard"))])
    tokens = []
    for m in _TOKEN.finditer(text.rstrip()):
        if m["bad"]:
            raise InvalidQuery(f"cannot parse {text!r} at {m.start()}")
        tokens.append((m.lastgroup if m.lastgroup != "slop" else "phrase", m))
    at = 0

    def peek(*ops: str) -> bool:
        return at < len(tokens) and tokens[at][0] == "op" and tokens[at][1]["op"] in ops

    def leaf(name: str, raw: str) -> Node | None:
        found = analyze(name, re.sub(r"\\(.)", r"\1", raw))
        if not found:
            return None
        if len(found) == 1:
            return Term(name, found[0][0])
        return Phrase(name, tuple(t for t, _ in found), tuple(p for _, p in found))

    def clause(name: str) -> Node | None:
        nonlocal at
        if at >= len(tokens):
            raise InvalidQuery(f"{text!r} ends too early")
        kind, m = tokens[at]
        if kind == "field":
            at += 1
            return clause(re.sub(r"\\(.)", r"\1", m["field"]))
        if peek("("):
            at += 1
            node = group(name, nested=True)
        elif kind == "phrase":
            at += 1
            if not m["phrase"]:
                raise InvalidQuery("a phrase needs a term")
            node = leaf(name, m["phrase"])
        elif kind == "term":
            at += 1
            raw = m["term"]
            if raw == "*" or "?" in raw or "*" in raw[:-1]:
                raise InvalidQuery("unimplemented: only a prefix may have a wildcard")
            node = Prefix(name, raw[:-1].lower()) if raw.endswith("*") and not raw.endswith("\\*") else leaf(name, raw)
        else:
            raise InvalidQuery(f"cannot parse {text!r} at {m.start()}")
        if at < len(tokens) and tokens[at][0] == "boost":
            weight = float(tokens[at][1]["boost"][1:])
            at += 1
            node = node and node.boosted(weight)
        return node

    def group(name: str, nested: bool) -> Node | None:
        nonlocal at
        clauses: list[list] = []  # node, occurrence: must, should or not
        while at < len(tokens) and not peek(")"):
            joined = None
            if peek("AND", "&&", "OR", "||"):
                if not clauses:
                    raise InvalidQuery(f"{text!r} begins with an operator")
                joined = "or" if peek("OR", "||") else "and"
                at += 1
            occurs = "should" if joined == "or" else "must"
            if peek("+", "-", "!", "NOT"):
                occurs = occurs if peek("+") else "not"
                at += 1
            node = clause(name)
            if joined == "or" and clauses and clauses[-1][1] != "not":
                clauses[-1][1] = "should"
            if node is not None:
                clauses.append([node, occurs])
        if nested:
            if not peek(")"):
                raise InvalidQuery(f"{text!r} lacks a closing parenthesis")
            at += 1
        if not clauses:
            return None
        positive = [c for c in clauses if c[1] != "not"]
        if not positive:
            raise InvalidQuery("No positive clauses.")
        out = positive[-1][0]
        for k in range(len(positive) - 2, -1, -1):
            out = (And if positive[k + 1][1] == "must" else Or)(positive[k][0], out)
        for node, occurs in clauses:
            if occurs == "not":
                out = Difference(out, node)
        return out

    root = group(default_field, nested=False)
    if at < len(tokens):
        raise InvalidQuery(f"{text!r} has a parenthesis too many")
    if root is None:
        raise InvalidQuery(f"{text!r} has no term")
    return root


def quote_phrases(text: str, phrases: list[str]) -> str:
    """Puts known phrases of a free query in quotes, the longest first; quoted parts stay as they are."""
    parts = re.split(r'("[^"]*")', text)
    if known := sorted({p.strip() for p in phrases if " " in p.strip()}, key=len, reverse=True):
        pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, known)) + r")(?!\w)", re.I)
        parts = [p if p.startswith('"') else pattern.sub(r'"\1"', p) for p in parts]
    return "".join(parts)
