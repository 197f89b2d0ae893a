"""Benchmark decontamination by spaced seeds.

A seed mask keeps some of the token positions below it and ignores the others, so a hit survives substitutions at the
ignored places. Hashes of every document position and every benchmark position are joined; each hit fixes a diagonal
(document position minus item position), and the tokens along it are compared: the document is contaminated by the item
if some ``window`` aligned tokens (the whole item if it is shorter) agree in at least 80 per cent of places.

Tokens are runs of characters other than white space and ASCII punctuation (the underscore is kept), in lower case.
Items of one to four tokens have no place to differ and are sought as whole sequences.

The masks depend on the length of the item. Enumeration (in the tests) shows that each set hits every pattern of
substitutions that the rule accepts, so no passage that satisfies the rule is lost.

The index of a benchmark of at most ``SHIP_SEEDS`` seeds (counted, not assumed) is shipped to the tasks. A larger one is
dealt into as many indexes as it needs; executors write them into the shared folder, which has to be mounted as files, and
every task maps them into memory one after the other. Either way the scan is one map without a shuffle, and the same code
answers, so results do not depend on the size of the benchmark.

Cases: null or empty text is not contaminated. Repeated rows, rows that repeat an id, null document ids and repeated items
each get their own answer. Several items or ties are all listed, ascending and once each. Null item ids or texts are
ignored; ids that are not whole numbers are an error. Empty tables: nothing is contaminated. Only the ids and texts are
read, so extra columns may have any name. Memory is bounded by the longest text.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.shared import Scratch, chunks, long_id, mounted, small_batches
from broadsheet.llm.words import PUNCTUATION, U64, Words, _PLACE, mix

#: (least and most tokens of an item, masks; 1: the token counts, 0: it is ignored).
CLASSES = (
    (1, 1, ("1",)),
    (2, 2, ("11",)),
    (3, 3, ("111",)),
    (4, 4, ("1111",)),
    (5, 9, ("1111", "11011", "11101", "10111")),
    (10, 14, ("111011", "11010011", "11111")),
    (15, 1 << 62, ("1111011", "11010001011", "1100011011", "1111101")),
)
MASKS = tuple(dict.fromkeys(m for _, _, masks in CLASSES for m in masks))
WINDOW = 16
#: Of a window, at least this many hundredths agree.
AGREE = 80
#: Seeds of one index, about 60 MB with the tokens.
SHIP_SEEDS = 2_000_000
_FILTER_BITS = 22


def _tokens(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts.cast(pa.string())), separators=PUNCTUATION)


def _seeds(words: Words, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the masks, given by number: hashes, owners and places of all its positions."""
    for m in masks:
        counts = np.maximum(words.counts - len(MASKS[m]) + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(bounds[-1]) - bounds[owner]
        at = words.bounds[owner] + place
        h = np.full(len(at), U64(m + 1))
        for k, c in enumerate(MASKS[m]):
            if c == "1":
                h += words.hash[at + k] * _PLACE[k]
        yield mix(h), owner, place


def _item_seeds(words: Words, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The seeds of items: of each mask those of the items whose length calls for it."""
    for m, (h, owner, place) in zip(masks, _seeds(words, masks)):
        n = words.counts[owner]
        fit = np.zeros(len(n), bool)
        for low, high, own in CLASSES:
            if MASKS[m] in own:
                fit |= (n >= low) & (n <= high)
        yield h[fit], owner[fit], place[fit]


def agrees(doc: np.ndarray, item: np.ndarray, diagonal: int, window: int = WINDOW) -> bool:
    """Whether document and item agree along a diagonal."""
    start, end = max(0, diagonal), min(len(doc), diagonal + len(item))
    need = min(window, len(item))
    if not need or end - start < need:
        return False
    same = doc[start:end] == item[start - diagonal : end - diagonal]
    total = np.concatenate([[0], np.cumsum(same)])
    return bool((100 * (total[need:] - total[:-need]) >= AGREE * need).any())


class Index:
    """Sorted seed hashes of items, with a bit table that turns most positions away."""

    ARRAYS = ("ids", "tokens", "bounds", "hashes", "items", "places", "masks", "bits")

    def __init__(self, ids: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, items: np.ndarray, places: np.ndarray, masks: np.ndarray, bits: np.ndarray):
        self.ids, self.tokens, self.bounds, self.masks, self.bits = ids, tokens, bounds, masks, bits
        self.hashes, self.items, self.places = hashes, items, places

    def save(self, path: str) -> None:
        for name in self.ARRAYS:
            np.save(f"{path}-{name}.npy", getattr(self, name))

    @classmethod
    def load(cls, path: str) -> Index:
        return cls(*[np.load(f"{path}-{name}.npy", mmap_mode="r") for name in cls.ARRAYS])

    def search(self, words: Words) -> list[set[int]]:
        """Ids of the items that contaminate each text."""
        found: list[set] = [set() for _ in range(len(words.counts))]
        seen: set[tuple[int, int, int]] = set()
        for h, owner, place in _seeds(words, self.masks.tolist()):
            at = np.flatnonzero(self.bits[h & U64((1 << _FILTER_BITS) - 1)])
            low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                d = int(owner[p])
                for item, start in zip(self.items[a:b].tolist(), self.places[a:b].tolist()):
                    key = (d, item, int(place[p]) - start)
                    name = int(self.ids[item])
                    if name in found[d] or key in seen:
                        continue
                    seen.add(key)
                    if agrees(words.hash[words.bounds[d] : words.bounds[d + 1]], self.tokens[self.bounds[item] : self.bounds[item + 1]], key[2]):
                        found[d].add(name)
        return found


def build_index(ids: list[int], texts: list[str]) -> Index:
    words = _tokens(pa.array(texts, pa.string()))
    hashes, items, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Only masks that some item calls for are looked up.
    masks = [m for m in range(len(MASKS)) if any(MASKS[m] in own and ((words.counts >= low) & (words.counts <= high)).any() for low, high, own in CLASSES)]
    for h, owner, place in _item_seeds(words, masks):
        hashes.append(h), items.append(owner), places.append(place)
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[h & U64((1 << _FILTER_BITS) - 1)] = True
    return Index(np.array(ids, np.int64), words.hash, words.bounds, h[order], np.concatenate(items)[order], np.concatenate(places)[order], np.array(masks, np.int64), bits)


class Shelf:
    """The indexes of a benchmark: one that travels with the tasks, or paths of those in the shared folder."""

    def __init__(self, index: Index | None, paths: list[str]):
        self.index, self.paths = index, paths

    def search(self, texts: pa.Array) -> list[list[int]]:
        """Items that contaminate each text, ascending."""
        words = _tokens(texts)
        found: list[set] = [set() for _ in range(len(texts))]
        for index in [self.index] if self.index is not None else map(Index.load, self.paths):
            for mine, more in zip(found, index.search(words)):
                mine |= more
        return [sorted(f) for f in found]


_OUT = "id long, contaminated boolean, n_items long, items array<long>"


def _scan(batches: Iterator[pa.RecordBatch], shelf: Shelf) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = shelf.search(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([bool(f) for f in found]), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            names=["id", "contaminated", "n_items", "items"],
        )


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes one index over the items of a task; its path."""
    held = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("body", pa.string())]))
    if held.num_rows:
        os.makedirs(folder, exist_ok=True)
        # A name for each attempt: a second one does not touch files that are being read.
        path = f"{folder}/{uuid.uuid4().hex}"
        build_index(held.column("id").to_pylist(), held.column("body").to_pylist()).save(path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])


def _prepared(benchmark: DataFrame, item_col: str, item_text_col: str, ship_seeds: int) -> Shelf:
    items = benchmark.select(long_id(benchmark, item_col).alias("id"), F.col(item_text_col).cast("string").alias("body")).where("id is not null and body is not null")
    # An item of n characters has at most n / 2 + 1 tokens, and each starts one seed per mask of its class (four at most).
    (tokens,) = items.agg(F.sum(F.length("body") / 2 + 1)).first()
    bound = int(tokens or 0) * max(len(m) for _, _, m in CLASSES)
    if bound <= ship_seeds:
        rows = items.collect()
        return Shelf(build_index([r.id for r in rows], [r.body for r in rows]), [])
    scratch = Scratch(benchmark.sparkSession, "decontaminate")
    folder = mounted(f"{scratch.root}/index")
    parts = bound // max(ship_seeds, 1) + 1 if ship_seeds else 3
    # Dealt by the hash of id and text, so that items which share an id do not meet in one index.
    written = items.repartition(parts, F.xxhash64("id", "body")).mapInArrow(lambda it: _store(it, folder), "path string").collect()
    return Shelf(None, sorted(r.path for r in written))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ship_seeds: int = SHIP_SEEDS) -> DataFrame:
    """(id, contaminated, n_items, items) of every row of ``docs``."""
    source = docs.select(long_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    small_batches(docs.sparkSession)
    shelf = _prepared(benchmark, item_col, item_text_col, ship_seeds)
    return source.mapInArrow(lambda it: _scan(it, shelf), _OUT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ship_seeds: int = SHIP_SEEDS) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates."""
    small_batches(docs.sparkSession)
    shelf = _prepared(benchmark, item_col, item_text_col, ship_seeds)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            yield batch.filter(pa.array([not f for f in shelf.search(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
