"""Main text of web pages: structure first, then a suffix array over each host's undecided text.

A page falls into blocks. Markup drops only what it names by element, exact role or exact class or id: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments; an element that is named so by class or id
only does not take an ``article`` or ``main`` inside it along. If the page has an ``article`` or a main element, text
outside it goes too. Paragraphs, headings, list items, quotes, tables and the like inside it stay. What is left is
undecided: all text of pages without such an element, and loose text of other containers inside one. It is judged by what
the other pages of the host hold: tokens in runs of at least ``LEAST_TOKENS`` that a page with another stream holds too are
boilerplate and go; unique runs stay (a run that only reaches a few tokens into the next block leaves that block alone).

Pages with equal streams count as one page, so a page that is served under two addresses keeps its text. Text that the
markup calls the article is never judged so: sites repeat passages in many articles, and those are article text.

The undecided token streams of a host are concatenated and sorted into a suffix array. A host with more than
``SHARD_CHARS`` characters of them is dealt into shards with an array each; the shards then exchange the hashes of their
windows of ``LEAST_TOKENS`` tokens (of each at most two holders), so a run that pages of different shards share counts
like one inside a shard, and the number of shards changes no result. No task holds a whole host.

Cases: null html gives an empty text. Character references are decoded; white space inside a block becomes one space;
blocks are joined by one space. Unclosed and misnested tags close with what surrounds them; an unclosed raw element runs
to the end. A null or unusable url makes a host of its own for the page. Repeated rows, also of one page id, are equal
pages and each get a row. Extra columns are not read, so they may have any name. An empty table gives an empty result.
Memory is bounded by the longest page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.packed import runs
from broadsheet.llm.shared import Scratch, chunks, maybe_broadcast, small_batches
from broadsheet.llm.words import U64, Words, mix

LEAST_TOKENS = 5
SHARD_CHARS = 4_000_000
KEEP, UNSURE = 0, 1

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp svg math object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form button select option dialog menu head audio video canvas".split()) | _RAW
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())
#: Class and id names, as whole words, and roles of what is not article text.
_NAMES = frozenset(
    "nav navbar navigation site-nav main-nav menu main-menu site-menu breadcrumb breadcrumbs pagination pager share share-buttons "
    "footer site-footer page-footer sidebar side-bar "
    "notice site-notice cookie-notice cookie-banner cookie-consent consent-banner cookies consent gdpr "
    "ad ads advert adverts advertisement advertising sponsored "
    "comment comments comment-list commentlist comments-area reader-comments disqus_thread respond".split()
)
_HEADERS = frozenset("header site-header page-header masthead".split())
_ROLES = frozenset("navigation menu menubar banner contentinfo complementary search form dialog alertdialog".split())
_MAINS = frozenset("main main-content article article-body articlebody article-content story-body post-content entry-content".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that keep an article inside them from being main text.
_FIRM = frozenset("nav footer aside dialog menu".split())


def _named(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the attributes of an element mark it as no article text, and as the main element."""
    dropped = main = False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, words = key.lower(), (a or b or c).lower().split()
        if key in ("class", "id"):
            dropped |= any(w in _NAMES or (w in _HEADERS and not inside) for w in words)
            main |= any(w in _MAINS for w in words)
        elif key == "role":
            dropped |= any(w in _ROLES for w in words)
            main |= "main" in words
        elif key == "itemprop":
            main |= "articlebody" in words
        elif key == "hidden" or (key == "aria-hidden" and words == ["true"]) or (key == "style" and _HIDDEN.search(a or b or c)):
            dropped = True
    return dropped, main and not dropped


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(KEEP or UNSURE, text) of the page's blocks in order, dropped ones left out."""
    if not page:
        return []
    out: list[tuple[bool, bool, str]] = []  # inside the article, in a text element, text
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, dropped, inside, textual, in an element of _FIRM
    dropped = inside = textual = False
    piece: list[str] = []
    any_main = False

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                out.append((inside, textual, text))

    at, end = 0, len(page)
    lower: str | None = None
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            if not dropped:
                piece.append(page[at:])
            break
        if not dropped and m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            if not dropped and m.group().startswith("<![CDATA["):
                piece.append(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m.group(1):
            if name == "br" or name not in _INLINE:
                if not dropped:
                    flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(s[1] for s in stack[k:]) and not dropped:
                        flush()
                    del stack[k:]
                    _, dropped, inside, textual, _ = stack[-1] if stack else ("", False, False, False, False)
                    break
            continue
        attributes = m.group(3)
        if name in _RAW and not attributes.endswith("/"):
            if lower is None:
                lower = page.lower()
            stop = lower.find("</" + name, at)
            close = page.find(">", stop) if stop >= 0 else -1
            at = close + 1 if close >= 0 else end
            continue
        if name in _VOID or (attributes.endswith("/") and name not in _INLINE):
            if name in ("br", "hr") and not dropped:
                flush()
            continue
        if name not in _INLINE and not dropped:
            flush()
        if name in _CLOSES_P:
            # An open paragraph (and what is open in it) ends where a block begins.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    if not stack[k][1] or name in ("article", "main", "p"):
                        del stack[k:]
                        _, dropped, inside, textual, _ = stack[-1] if stack else ("", False, False, False, False)
                    break
                if stack[k][0] not in _INLINE:
                    break
        firm = name in _FIRM or (bool(stack) and stack[-1][4])
        marked, main = _named(attributes, inside) if attributes else (False, False)
        if name in ("html", "body"):
            marked, main = False, False
        elif name in ("article", "main"):
            main = not marked and not firm
        gone = marked or name in _DROPPED or (name == "header" and not inside) or (dropped and not (main and name in ("article", "main")))
        main &= not gone
        if gone and not dropped:
            flush()
        any_main |= main
        dropped, inside, textual = gone, inside or main, name in _TEXTUAL or (textual and name in _INLINE) or (textual and name in ("div", "span"))
        stack.append((name, dropped, inside, textual, firm))
    if not dropped:
        flush()
    if any_main:
        return [(KEEP if t else UNSURE, text) for i, t, text in out if i]
    return [(UNSURE, text) for _, _, text in out]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order by prefix doubling, and the ranks at each power of two."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n and width < n and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:]
        order = np.lexsort((second, rank))
        new = np.ones(n, np.int64)
        new[0] = 0
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        width *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the order."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width, rank = 1 << level, ranks[level]
        fit = (a + width <= n) & (b + width <= n)
        same = np.zeros(n - 1, bool)
        same[fit] = rank[a[fit]] == rank[b[fit]]
        got[same] += width
        a[same] += width
        b[same] += width
        a[a >= n], b[b >= n] = n - 1, n - 1
    out[1:] = got
    return out


class Streams:
    """The undecided tokens of some pages of a host, one page after the other with a separator of its own before each."""

    def __init__(self, pages: list[list[str]]):
        ids, page, self.bounds = [], [], []
        numbers: dict[str, int] = {}
        for p, texts in enumerate(pages):
            ids.append(-1 - p)
            page.append(p)
            for k, text in enumerate(texts):
                words = text.split(" ")
                self.bounds.append((p, k, len(ids), len(ids) + len(words)))
                ids += [numbers.setdefault(w, len(numbers)) for w in words]
                page += [p] * len(words)
        self.tokens, self.page = np.array(ids, np.int64), np.array(page, np.int64)
        #: Names of the pages' streams, the same in every shard.
        names = [hashlib.blake2b("\n".join(t).encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in pages]
        self.name = np.array([int.from_bytes(n, "little", signed=True) for n in names], np.int64)
        words = Words(pa.array(list(numbers), pa.string()), separators=np.zeros(256, bool))
        self.hash = words.hash

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of every window of ``least`` tokens of one page."""
        if len(self.tokens) < least:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        parts = np.concatenate([[0], np.cumsum(self.tokens < 0)])
        at = np.flatnonzero(parts[least:] == parts[:-least])
        out = np.full(len(at), U64(least))
        for k in range(least):
            out = mix(out + self.hash[self.tokens[at + k]] * U64(2 * k + 1))
        return out, at

    def shared(self, least: int, known: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run that a page with another stream holds too.

        ``known``: sorted hashes of windows that are shared with a page of another shard.
        """
        found = [np.zeros(0, np.int64)]
        if len(np.unique(self.name)) > 1:
            order, ranks = suffix_array(self.tokens)
            starts = np.flatnonzero(common_prefixes(order, ranks) < least)
            sizes = np.diff(np.append(starts, len(order)))
            held = self.name[self.page[order]]
            several = np.minimum.reduceat(held, starts) != np.maximum.reduceat(held, starts)
            found.append(order[np.repeat(several, sizes)])
        if len(known):
            h, at = self.windows(least)
            h = h.view(np.int64)
            found.append(at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h])
        starts = np.concatenate(found)
        covered = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, np.minimum(starts + least, len(self.tokens)), -1)
        return np.cumsum(covered)[:-1] > 0


def whole_runs(flags: np.ndarray, least: int) -> np.ndarray:
    """Covered tokens of a block, without stretches below ``least`` that are only the end of a run of the block beside it;
    a block that is covered as a whole goes, however short."""
    if flags.all() or not flags.any():
        return flags
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    out = np.zeros(len(flags), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= least
    return out


_HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, 2):
        hosts, kinds, texts, sizes = [], [], [], []
        for url, page in zip(part.column(1), part.column(2)):
            m = _HOST.match(url.as_py() or "")
            hosts.append(m.group(1).lower() if m else None)
            got = blocks(page.as_py())
            kinds.append([k for k, _ in got])
            texts.append([t for _, t in got])
            sizes.append(sum(len(t) for k, t in got if k == UNSURE))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(kinds, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(sizes, pa.int64())],
            names=["id", "url", "host", "kinds", "texts", "size"],
        )


def _offers(table: pa.Table, least: int) -> pa.Table:
    """The distinct windows of a shard, each with two of the streams that hold it (twice the same if there is one)."""
    s = Streams(table.column("texts").to_pylist())
    h, at = s.windows(least)
    order = np.argsort(h, kind="stable")
    h, held = h[order].view(np.int64), s.name[s.page[at[order]]]
    starts = runs(h)
    low, high = (np.minimum.reduceat(held, starts), np.maximum.reduceat(held, starts)) if len(h) else (held, held)
    n = len(starts)
    return pa.table([pa.array([table.column("host")[0].as_py()] * n, pa.string()), pa.array(np.full(n, table.column("shard")[0].as_py())), pa.array(h[starts]), pa.array(low), pa.array(high)], names=["host", "shard", "window", "low", "high"])


def _decide(table: pa.Table, known: pa.Table, least: int) -> pa.Table:
    """(row, at, kept) of the pages of which something goes: the blocks concerned and what is left of them."""
    out: dict[int, list[tuple[int, str]]] = {}
    if table.num_rows:
        texts = table.column("texts").to_pylist()
        s = Streams(texts)
        covered = s.shared(least, np.sort(known.column("window").to_numpy()))
        for p, k, a, b in s.bounds:
            gone = whole_runs(covered[a:b], least)
            if gone.any():
                out.setdefault(p, []).append((k, " ".join(w for w, g in zip(texts[p][k].split(" "), gone) if not g)))
    rows, numbers = table.column("row").to_pylist(), table.column("numbers")
    return pa.table(
        [pa.array([rows[p] for p in out], pa.int64()), pa.array([[numbers[p][k].as_py() for k, _ in x] for p, x in out.items()], pa.list_(pa.int32())), pa.array([[t for _, t in x] for x in out.values()], pa.list_(pa.string()))],
        names=["row", "at", "kept"],
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_TOKENS) -> DataFrame:
    """(id, url, text) of every row."""
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "html")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"id {dict(source.dtypes)['id']}, url string, host string, kinds array<int>, texts array<string>, size long"
    # Rows are numbered as they are written, so a number stays with its row whatever is computed again.
    parsed = scratch.keep(source.mapInArrow(_parse, schema).withColumn("row", F.monotonically_increasing_id()), "parsed")

    undecided = F.filter(F.arrays_zip(F.col("kinds").alias("kind"), F.col("texts").alias("text"), F.sequence(F.lit(0), F.size("kinds") - 1).alias("number")), lambda b: b.kind == UNSURE)
    open_ = parsed.where("size > 0").withColumn("b", undecided).select("row", "host", "size", F.col("b.text").alias("texts"), F.col("b.number").alias("numbers"))
    shards = open_.where("host is not null").groupBy("host").agg(F.ceil(F.sum("size") / SHARD_CHARS).cast("long").alias("shards"))
    shards = scratch.keep(shards, "shards")
    # A page without a host has no neighbours.
    dealt = open_.join(maybe_broadcast(shards, shards.count()), "host").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    columns = ["host", "shard", "row", "texts", "numbers"]
    offers = dealt.where("shards > 1").select(*columns).groupBy("host", "shard").applyInArrow(lambda t: _offers(t, least), "host string, shard long, window long, low long, high long")
    offers = scratch.keep(offers, "offers")
    held = offers.groupBy("host", "window").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # A table of its own, so that the rows of a window which every shard holds can be split in the join.
    shared = scratch.keep(held.where("low <> high").select("host", "window"), "shared")
    known = offers.select("host", "shard", "window").join(shared, ["host", "window"], "left_semi").select("host", "shard", "window")
    decided = dealt.select(*columns).groupBy("host", "shard").cogroup(known.groupBy("host", "shard")).applyInArrow(lambda a, b: _decide(a, b, least), "row long, at array<int>, kept array<string>")
    decided = scratch.keep(decided, "decided")
    left = F.transform("texts", lambda t, i: F.coalesce(F.try_element_at(F.map_from_arrays("at", "kept"), i), t))
    # Rows are wide: counted in units of a hundred characters.
    size = decided.agg(F.count("*") + F.sum(F.length(F.array_join("kept", ""))) / 100).first()[0]
    out = parsed.join(maybe_broadcast(decided, size or 0), "row", "left")
    return out.select("id", "url", F.array_join(F.filter(left, lambda t: t != ""), " ").alias("text"))
