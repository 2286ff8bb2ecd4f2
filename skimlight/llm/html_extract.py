"""Main-text extraction by equivalence classes of page tokens within a host.

A token is an element in its place (the chain of tags and classes above it) or a
text in such a place. Over the pages of a host each token has an occurrence vector
(how often it is on which page); tokens with equal vectors form a class. A class is
valid if its tokens stand in one order on all pages, and if it is nested: the
elements they stand in belong to it or to valid classes. The valid classes on half
a host's pages are its template, and what its elements leave open are slots. Texts
of the template (notices, share lines, menus without a mark) are dropped on every
page. The text of a page is what fills the slots below the template's content
element: from the top, the element goes down to the one below it that holds all the
text left, or to one marked as the article that holds half of it.

Pages that copy one another would make an article look like a template. A text is
therefore the template's only if it is on half the host's independent pages, those
told apart by each of three minhashes of their word shingles; in the content element
it also has to make up a small part of the text.

Vectors are never built: a token's vector is known by a sum of hashes of (page,
count), which tasks combine before they send. A template holds tokens found on at
least half the pages of its host, so it is no longer than two pages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import host_of
from .util import materialise, slices, stored_bytes

#: A token is in the template from this share of a host's pages; a text, of at least so many independent ones.
LEAST_SHARE, LEAST_PAGES = 0.5, 2
#: Texts of the template in the content element: their greatest share of its text on the host, and on a page.
MOST_OF_HOST, MOST_OF_PAGE = 0.25, 0.5
#: Minhashes that tell pages apart, and words of their shingles.
MINHASHES, SHINGLE = 3, 4
#: Templates up to this size are broadcast; beyond it, pages are dealt by host and salt.
BROADCAST_BYTES, SALTS = 4 << 20, 64

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th"
    " thead title tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Closed by the next of the same kind, and elements beyond which none is looked for.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = set("ul ol dl table select div section article body".split())
#: Elements that can hold the content, and those that hold no main text.
CONTAINERS = set("html body article main section div center blockquote table tbody tr td".split())
ASIDE_TAGS = set(
    "nav footer aside form script style noscript template head select option button textarea iframe svg object dialog menu canvas audio video".split()
)
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that a class or id can set aside, the words that do so, and those that may stand beside them in a name.
NAMED = set("div section ul ol dl table article main figure details fieldset center header p span a".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos banner sidebar sidebars"
    " menu menus nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup signin login comment comments commentlist disqus respond reply replies related"
    " search recommended recommendations share sharing social widget widgets toolbar pagination pager masthead copyright disclaimer skip hidden".split()
)
PLAIN_WORDS = set("area bar block body box btn button buttons container content form group inner item items left link links list main page panel right section site text top bottom wrap wrapper".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S | re.A,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.A)
WORDS = re.compile(r"[a-z]+|\d+", re.A)


def _lies_aside(tag: str, names: list[list[str]], inside: bool) -> bool:
    """Whether a class name or id says so: one made of such words alone, but for plain ones. In an article, of containers only."""
    if tag not in NAMED or inside and tag in ("p", "span", "a"):
        return False
    if tag in ("article", "main"):
        return any(n and n[0] in ASIDE_WORDS for n in names)
    return any(not ASIDE_WORDS.isdisjoint(n) and all(w in ASIDE_WORDS or w in PLAIN_WORDS or w.isdigit() for w in n) for n in names)


def _hash(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), parent)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Page:
    """Elements of a page in order, each with its parent, place and whether it lies aside; blocks of text.

    All that is asked about the elements above one is known when it opens, so reading a page is linear in its length.
    """

    def __init__(self, source: str | None):
        self.tag, self.parent, self.place, self.aside = ["#"], [-1], [0], [False]
        self.hard = [False]  # in an element whose tag sets it aside
        self.inside = [False]  # in an article or main element
        self.header = [0]  # 1: in a header; 2: in one of an article, whose headings are the article's
        self.heading = [False]  # in a heading (below the header, if in one)
        self.content: list[int] = []  # article and main elements
        self.blocks: list[tuple[int, str]] = []  # element, text
        self._words: list[str] = []
        self._stack, self._bound = [0], [0]  # open elements; of each the place in the stack of the next sibling or bound at or above it
        self._opened: Counter = Counter()
        self._owner, self._p = 0, 0
        at, source = 0, source or ""
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag:
                tag = tag.lower()
                self._close(tag) if m["end"] else self._open(tag, m["attrs"])
            elif m["raw"]:
                self._words.append(" ")
        if at < len(source):
            self._text(source[at:])
        self._flush()
        self._lift()

    def _text(self, raw: str) -> None:
        if not self._words:
            self._owner = self._stack[-1]
        self._words.append(html.unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        if self._words:
            text = " ".join("".join(self._words).split())
            if text:
                self.blocks.append((self._owner, text))
            self._words = []

    def _pop(self, k: int) -> None:
        """Closes all from place k of the stack."""
        for i in self._stack[k:]:
            self._opened[self.tag[i]] -= 1
        del self._stack[k:], self._bound[k:]
        if self._p >= k:
            self._p = 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._words.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            if self._p and tag != "button":
                self._pop(self._p)
            elif tag in SIBLINGS:
                k = self._bound[-1]
                while k > 0:
                    found = self.tag[self._stack[k]]
                    if found in SIBLINGS[tag] and (tag != "tr" or found == "tr"):
                        self._pop(k)
                        break
                    if found in BOUNDS:
                        break
                    k = self._bound[k - 1]
        if tag in VOID:
            return
        names, role, hidden = [], "", False
        if attrs and not attrs.isspace():
            for name, a, b, c in ATTRIBUTE.findall(attrs):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id"):
                    names += map(WORDS.findall, value.split())
                elif name == "role":
                    role = value
                elif name == "style":
                    hidden |= "display:none" in value.replace(" ", "")
                else:
                    hidden |= value != "false"
        up, i, depth = self._stack[-1], len(self.tag), len(self._stack)
        article = tag in ("article", "main") or role in ("article", "main")
        header = tag == "header" or (tag in ("div", "section", "hgroup") and any("header" in n for n in names))
        hard = tag in ASIDE_TAGS or role in ASIDE_ROLES or hidden
        marked = hard or _lies_aside(tag, names, self.inside[up])
        if article and not marked and not self.hard[up]:
            self.content.append(i)
        self.tag.append(tag)
        self.parent.append(up)
        # numbers in a class or id differ from page to page
        self.place.append(_hash(self.place[up], ".".join([tag, *(w for n in names for w in n if not w.isdigit())])) if tag in BLOCKS else self.place[up])
        self.aside.append(self.aside[up] or marked)
        self.hard.append(self.hard[up] or hard)
        self.inside.append(self.inside[up] or article)
        self.header.append((2 if self.inside[up] else 1) if header else self.header[up])
        self.heading.append(not header and (self.heading[up] or tag in HEADINGS))
        self._stack.append(i)
        self._bound.append(depth if tag in SIBLINGS or tag in BOUNDS else self._bound[-1])
        self._opened[tag] += 1
        if tag == "p":
            self._p = depth

    def _close(self, tag: str) -> None:
        if tag in BLOCKS or tag == "br":
            self._flush()
        if self._opened[tag] > 0:
            k = len(self._stack) - 1
            while self.tag[self._stack[k]] != tag:
                k -= 1
            self._pop(k)

    def _lift(self) -> None:
        """The elements that contain the only article do not lie aside, whatever their class says."""
        if len(self.content) == 1 and self.aside[first := self.content[0]]:
            i = first
            while i > 0:
                self.aside[i] = False
                i = self.parent[i]
            own = {first}
            for i in range(first + 1, len(self.tag)):  # what had only been marked from above
                if self.parent[i] in own and self.tag[i] not in ASIDE_TAGS:
                    own.add(i)
                    self.aside[i] = False
        self.content = [i for i in self.content if not self.aside[i]]

    def below(self, roots: set[int]) -> list[bool]:
        """Per element: whether it is one of the roots or below one."""
        out = [False] * len(self.tag)
        for i in range(len(self.tag)):
            out[i] = i in roots or (i > 0 and out[self.parent[i]])
        return out

    def own_blocks(self) -> list[tuple[int, str]]:
        """Blocks that lie neither aside nor in a header."""
        return [(i, t) for i, t in self.blocks if not self.aside[i] and not (self.header[i] == 1 or self.header[i] == 2 and not self.heading[i])]

    def text_token(self, i: int, text: str) -> int:
        return _hash(self.place[i], text)


def minhashes(texts: list[str]) -> list[int]:
    """The least of the hashes of all shingles of words, for each of MINHASHES hash functions."""
    words = " ".join(texts).split()
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n if len(h) else 1, np.uint64)
    for j in range(SHINGLE if len(h) else 0):
        part = h[j : j + n]
        out[: len(part)] = out[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part
    result = []
    for salt in range(MINHASHES):
        z = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
        result.append(int((z ^ (z >> np.uint64(32))).min() >> np.uint64(33)))
    return result


def page_tokens(source: str | None) -> tuple[list[tuple], list[int]]:
    """Rows (token, kind, up, n, pos, chars, flags), and the page's minhashes.

    kind 0: an element, with the characters of own text below it; 1: a text. up: the
    place it stands in. pos: that of its first occurrence. flags of an element: 1 if it
    can hold the content, 2 if it is marked as an article, 4 if it lies aside.
    """
    page = Page(source)
    blocks = page.own_blocks()
    chars = [0] * len(page.tag)
    for i, text in blocks:
        chars[i] += len(text)
    for i in range(len(page.tag) - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
    found: dict[tuple[int, int], list[int]] = {}
    content = set(page.content)

    def add(key: tuple[int, int], up: int, pos: int, size: int, flags: int) -> None:
        row = found.setdefault(key, [up, 0, pos, 0, flags])
        row[1] += 1
        row[3] += size
        row[4] |= flags

    for i, tag in enumerate(page.tag):
        if tag in BLOCKS or i == 0:
            up = page.place[page.parent[i]] if i else 0
            add((page.place[i], 0), up, 2 * i, chars[i], (tag in CONTAINERS or i == 0) + 2 * (i in content) + 4 * page.aside[i])
    for i, text in blocks:
        add((page.text_token(i, text), 1), page.place[i], 2 * i + 1, len(text), 0)
    return [(_signed(t), k, _signed(r[0]), *r[1:]) for (t, k), r in found.items()], minhashes([t for _, t in blocks])


def main_text(source: str | None, fixed: set[int] = frozenset(), root: int | None = None) -> str:
    """Blocks in the slots of the page: below the template's content element; without one below its articles; else all."""
    page = Page(source)
    roots = {i for i, p in enumerate(page.place) if _signed(p) == root and page.tag[i] in BLOCKS} or set(page.content)
    inside = page.below(roots) if roots else None
    blocks = [(i, t) for i, t in page.own_blocks() if inside is None or inside[i]]
    own = [t for i, t in blocks if _signed(page.text_token(i, t)) not in fixed] if fixed else [t for _, t in blocks]
    if roots and sum(map(len, own)) < (1 - MOST_OF_PAGE) * sum(len(t) for _, t in blocks):
        own = [t for _, t in blocks]  # a copy of another page's text, not a template
    return "\n\n".join(own)


def deduce(rows: list[dict]) -> tuple[int | None, list[int]]:
    """Content element and fixed texts of a host, from its common tokens.

    rows: token, kind, up, on, pages, chars, flags, size (members of its class), ordered, once (never twice on a page),
    alone (independent pages with it), hosts (those of the host).
    """
    elements = {r["token"]: r for r in rows if r["kind"] == 0}
    by_class: dict[tuple, list[dict]] = {}
    for r in rows:
        by_class.setdefault((r["on"], r["vector"]), []).append(r)
    # nested: what a class stands in belongs to it or to valid classes, up to the page itself
    valid: dict[tuple, bool] = {}

    def nested(key: tuple) -> bool:
        todo = [key]
        while todo:
            k = todo[-1]
            if k not in valid:
                valid[k] = all(r["ordered"] for r in by_class[k])  # taken for valid while its surroundings are looked at
                above = {(elements[r["up"]]["on"], elements[r["up"]]["vector"]) for r in by_class[k] if r["token"] and r["up"] in elements}
                todo += [a for a in above - {k} if a not in valid]
            else:
                todo.pop()
                valid[k] = valid[k] and all(
                    r["up"] in elements and valid.get((elements[r["up"]]["on"], elements[r["up"]]["vector"]), False) for r in by_class[k] if r["token"]
                )
        return valid[key]

    for key in by_class:
        nested(key)
    template = {r["token"] for k, members in by_class.items() if valid[k] for r in members if r["kind"] == 0}
    texts = [
        r for k, members in by_class.items() if valid[k] and len(members) > 1 for r in members
        if r["kind"] == 1 and r["alone"] >= max(LEAST_PAGES, LEAST_SHARE * r["hosts"])
    ]
    inner: dict[int, list[int]] = {}
    for t, r in elements.items():
        if t:
            inner.setdefault(r["up"], []).append(t)
    order = [0]  # each place after the one it stands in
    for t in order:
        order += inner.get(t, [])
    fixed_below: Counter = Counter()
    for r in texts:
        fixed_below[r["up"]] += r["chars"]
    for t in reversed(order[1:]):
        fixed_below[elements[t]["up"]] += fixed_below[t]
    open_ = {t: r["chars"] - fixed_below[t] for t, r in elements.items()}
    root = 0
    while 0 in elements:
        fit = [t for t in inner.get(root, []) if t in template and elements[t]["once"] and elements[t]["flags"] & 5 == 1]
        held = [t for t in fit if open_[t] >= open_[root] > 0 or elements[t]["flags"] & 2 and 2 * open_[t] >= open_[root]]
        if not held:
            break
        root = max(held, key=lambda t: (open_[t], elements[t]["flags"] & 2, t))
    whole = elements[root]["chars"] if root in elements else 0
    drop = texts
    if root and fixed_below[root] > MOST_OF_HOST * whole:
        kept = [root]  # the places below the content element keep all their texts
        for t in kept:
            kept += inner.get(t, [])
        drop = [r for r in texts if r["up"] not in set(kept)]
    return (root or None), [r["token"] for r in drop]


def host_templates(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, texts (fixed texts of the template), root (place of the content element; null: the page).

    Null html is an empty page, null URLs share the empty host; an empty table has no
    templates. Pages repeated as a whole change nothing: shares stay, and independent
    pages are counted once. A host with one independent page has no fixed texts, but a
    content element.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int8())
        for batch in batches:
            for part in slices(batch, text=2):
                at, rows, marks = [], [], []
                for i, source in enumerate(part.column(2).to_pylist()):
                    found, m = page_tokens(source)
                    at += [i] * len(found)
                    rows += found
                    marks += [m] * len(found)
                own = pa.array(at, pa.int64())
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                hashes = [pa.array([m[k] for m in marks], pa.int32()) for k in range(MINHASHES)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), *columns, *hashes],
                    names=["host", "page", "token", "kind", "up", "n", "pos", "chars", "flags", *(f"m{k}" for k in range(MINHASHES))],
                )

    key = F.xxhash64(url_col, F.length(html_col), F.crc32(F.col(html_col).cast("binary")))
    named = pages.select(host_of(url_col).alias("host"), key.alias("page"), F.col(html_col).alias("html"))
    schema = "host string, page long, token long, kind tinyint, up long, n int, pos int, chars long, flags tinyint"
    found = materialise(named.mapInArrow(tokens, schema + "".join(f", m{k} int" for k in range(MINHASHES))), "tokens")
    vector = F.sum(F.xxhash64("page", "n").bitwiseAND(F.lit((1 << 32) - 1)))
    stats = found.groupBy("host", "token", "kind").agg(
        vector.alias("vector"), F.count(F.lit(1)).alias("on"), F.sum("chars").alias("chars"), F.bit_or("flags").alias("flags"),
        (F.max("n") == 1).alias("once"), F.min("up").alias("up"),
    )
    sizes = pages.groupBy(host_of(url_col).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    common = materialise(stats.join(sizes, "host").where(F.col("on") >= LEAST_SHARE * F.col("pages")), "common")
    # occurrences of common tokens, with their class
    classes = common.select("host", "token", "kind", "on", "vector")
    if stored_bytes(pages.sparkSession, classes) <= BROADCAST_BYTES:
        seen = found.join(F.broadcast(classes), ["host", "token", "kind"])
    else:
        salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        seen = found.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "token", "kind", "salt"])
    seen = materialise(seen.select("host", "token", "kind", "on", "vector", "page", "pos", *(f"m{k}" for k in range(MINHASHES))), "seen")
    in_order = F.transform(F.array_sort(F.collect_set(F.struct("pos", "kind", "token"))), lambda x: F.struct(x["kind"], x["token"]))
    orders = seen.groupBy("host", "on", "vector", "page").agg(F.xxhash64(in_order).alias("sign"))
    ordered = orders.groupBy("host", "on", "vector").agg((F.min("sign") == F.max("sign")).alias("ordered"))
    marks = F.array(*[F.approx_count_distinct(f"m{k}") for k in range(MINHASHES)])
    alone = seen.where("kind = 1 or token = 0").groupBy("host", "token", "kind").agg(F.array_min(marks).alias("alone"))
    hosts = alone.where("kind = 0").select("host", F.col("alone").alias("hosts"))
    rows = (
        common.join(ordered, ["host", "on", "vector"]).join(alone, ["host", "token", "kind"], "left").join(hosts, "host")
        .select("host", "token", "kind", "up", "on", "vector", "chars", "flags", "once", "ordered", F.coalesce("alone", F.lit(0)).alias("alone"), "hosts")
    )

    def solve(group: pa.Table) -> pa.Table:
        root, texts = deduce(group.to_pylist())
        return pa.table({"host": group.column("host")[:1], "texts": pa.array([texts], pa.list_(pa.int64())), "root": pa.array([root], pa.int64())})

    return rows.groupBy("host").applyInArrow(solve, "host string, texts array<long>, root long")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, text (empty if none), n_chars (code points).

    Character references are decoded; in a block each run of white space is one space and
    none is at its ends; blocks are joined in page order by two line feeds. Null html is
    empty. Pages without a host share a template. Texts of any length are read whole, in
    linear time. Of elements that could equally be the content, the one with most text
    wins, then the greater hash of its place. Repeated rows are extracted each, and
    repeating all pages changes no text. An empty table gives an empty result; other
    columns are not read.
    """
    templates = materialise(host_templates(pages, url_col, html_col), "templates")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    if stored_bytes(pages.sparkSession, templates) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(templates), "host", "left")
    else:  # the pages of a large host go to many tasks, each with a copy of its template
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.crc32(F.col("html").cast("binary"))), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text=2):
                text = [
                    main_text(h, set(t or ()), r)
                    for h, t, r in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                    names=["id", "url", "text", "n_chars"],
                )

    kind = pages.schema[id_col].dataType.simpleString()
    out = joined.select("id", "url", "html", "texts", "root").mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
