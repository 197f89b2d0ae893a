"""Removal of long word sequences that a document with a smaller id also holds: fixed-block anchors.

1. Index: every document is cut into non-overlapping blocks of 25 words. Probe: every rolling window of 25 words of every
   document. Block and probe meet by hash in a packed exchange. A run of 50 words that two documents share holds a whole
   block of either of them, so each shared run has a hit (hashes are cut to 40 bits here: a false hit costs time only).
2. Hits go back to their documents and are extended: every 50-word window around a hit is a candidate. Candidates of
   different documents meet again under two 48-bit hashes, and a window is repeated if its smallest holder is another
   document. Adjacent repeated windows join into maximal repeats, and the words that they cover go.

Pre-aggregation: what one task (or bucket of documents) holds twice is settled there, and only one holder of each hash
travels on, so a passage or a copy that a third of all documents hold reaches a reducer once per task, not once per
document. No step makes pairs of documents.

Cases: null or empty text has no words and keeps none. Fewer words than a window: nothing is removed. Ids should differ:
rows that repeat an id count as one document (an equal id is not smaller), and what is repeated in one of them is cut
from each. A null id counts as the largest id; ids that are not whole numbers are an error. An empty table gives an empty
result. Only the id and the text are read, so extra columns may have any name.

A bucket of documents or hashes is held by one task; the number of buckets follows from the counted bytes of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm import packed
from broadsheet.llm.packed import slot_column
from broadsheet.llm.shared import Scratch, buckets, chunks, long_id, release, small_batches, text_bytes, tidy
from broadsheet.llm.words import Words, mix

WINDOW = 50
#: Bytes of each of the two hashes that name a window.
HASH_BYTES = 6
#: Stands for a null id.
NO_ID = 2**63 - 1
_SPLIT = np.uint64(0xA24BAED4963EE407)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h ^ _SPLIT)) % np.uint64(n)).astype(np.int32)


def _per_group(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, how) -> np.ndarray:
    return np.repeat(how.reduceat(values, starts), sizes) if len(values) else values


def _anchors(batches: Iterator[pa.RecordBatch], n_buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Entries of blocks and probes for the exchange, and hits that the chunk itself settles (bucket -1 - document bucket)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in chunks(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = Words(batch.column(1))
        h, bounds, at = words.windows(block)
        if not len(h):
            continue
        doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
        place = (at - words.bounds[doc]).astype(np.uint32)
        owner = ids[doc]
        order = np.argsort(h, kind="stable")
        sh, so = h[order], owner[order]
        starts = packed.runs(sh)
        sizes = np.diff(np.append(starts, len(sh)))
        shared = np.minimum.reduceat(so, starts) != np.maximum.reduceat(so, starts)
        local = np.zeros(len(h), bool)
        local[order] = np.repeat(shared, sizes)
        # Of a hash that several documents of the chunk hold, one entry travels: a block if there is one.
        key = np.where(place[order] % block == 0, 0, 1)
        best = np.repeat(np.minimum.reduceat(key, starts), sizes)
        candidate = np.flatnonzero((key == best) & np.repeat(shared, sizes))
        _, lead = np.unique(np.repeat(np.arange(len(starts)), sizes)[candidate], return_index=True)
        travels = ~local
        travels[order[candidate[lead]]] = True
        if local.any():
            yield packed.pack(-1 - packed.slot(owner[local], n_buckets), owner[local], place[local])
        held.append((h[travels], owner[travels], place[travels]))
        size += int(travels.sum())
        del words, h, at, doc, place, owner, order, sh, so, starts, sizes, shared, local, key, best, candidate, travels
        if size >= packed.FLUSH:
            yield _flush(held, n_buckets)
            held, size = [], 0
    if held:
        yield _flush(held, n_buckets)


def _flush(held: list[tuple[np.ndarray, ...]], n_buckets: int) -> pa.RecordBatch:
    h, owner, place = (np.concatenate(x) for x in zip(*held))
    return packed.pack(_bucket(h, n_buckets), owner, place, h)


def _meet(table: pa.Table, n_buckets: int, block: int) -> pa.Table:
    """Hits of a bucket: probes that meet a block of another document, and blocks that meet anything of another one."""
    key = table.column("bucket")[0].as_py()
    owner, place, h, _ = packed.unpack(table)
    if key >= 0:
        order = np.argsort(h, kind="stable")
        h, owner, place = h[order], owner[order], place[order]
        starts = packed.runs(h)
        sizes = np.diff(np.append(starts, len(h)))
        is_block = place % block == 0
        big, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        low = _per_group(np.where(is_block, owner, big), starts, sizes, np.minimum)
        high = _per_group(np.where(is_block, owner, small), starts, sizes, np.maximum)
        low_all, high_all = _per_group(owner, starts, sizes, np.minimum), _per_group(owner, starts, sizes, np.maximum)
        probe = (low != big) & ((low != owner) | (high != owner))
        source = is_block & ((low_all != owner) | (high_all != owner))
        hit = probe | source
        owner, place = owner[hit], place[hit]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
    return pa.Table.from_batches([packed.pack(packed.slot(owner, n_buckets), owner, place)], packed.ARROW)


def _places(table: pa.Table) -> dict[int, np.ndarray]:
    """Places by document, ascending."""
    owner, place, _, _ = packed.unpack(table)
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    starts = packed.runs(owner)
    return {int(owner[a]): place[a:b] for a, b in zip(starts, np.append(starts[1:], len(owner)))}


def _candidates(docs: pa.Table, hits: pa.Table, n_buckets: int, n_windows: int, window: int, block: int) -> pa.Table:
    """Windows around hits: those that the bucket settles as repeated, and one holder of each hash for the exchange."""
    if not docs.num_rows or not hits.num_rows:
        return ARROW_EMPTY
    marks = _places(hits)
    out, held = [], []
    ids_all = docs.column("id").to_numpy()
    docs = docs.filter(pa.array(np.isin(ids_all, np.fromiter(marks, np.int64, len(marks))))).select(["id", "body"])
    for batch in chunks(iter(docs.combine_chunks().to_batches())):
        ids = batch.column(0).to_numpy()
        words = Words(batch.column(1), second=True)
        h1, bounds, at = words.windows(window)
        h2, _, _ = words.windows(window, "hash2")
        if not len(h1):
            continue
        keep = np.zeros(len(h1), bool)
        for d, i in enumerate(ids):
            n = bounds[d + 1] - bounds[d]
            if n:
                seen = np.zeros(n + window - block + 2, np.int32)
                mark = marks[int(i)]
                seen[mark[mark < len(seen) - 1] + 1] = 1
                np.cumsum(seen, out=seen)
                keep[bounds[d] : bounds[d + 1]] = seen[window - block + 1 : window - block + 1 + n] > seen[:n]
        doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
        held.append((h1[keep], h2[keep], ids[doc][keep], (at - words.bounds[doc]).astype(np.uint32)[keep]))
    if not held:
        return ARROW_EMPTY
    h1, h2, owner, place = (np.concatenate(x) for x in zip(*held))
    repeated, first = _settle(h1, h2, owner)
    if repeated.any():
        out.append(packed.pack(-1 - packed.slot(owner[repeated], n_windows), owner[repeated], place[repeated]))
    if first.any():
        out.append(packed.pack(_bucket(h1[first], n_windows), owner[first], place[first], h1[first], h2[first], HASH_BYTES))
    return pa.Table.from_batches(out, packed.ARROW)


ARROW_EMPTY = pa.Table.from_batches([], packed.ARROW)


def _settle(h1: np.ndarray, h2: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a smaller holder here, and which are of the smallest holder."""
    repeated = np.zeros(len(h1), bool)
    if len(h1):
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        low = _per_group(owner[order], starts, np.diff(np.append(starts, len(a))), np.minimum)
        repeated[order] = owner[order] > low
    return repeated, ~repeated


def _decide(table: pa.Table, n_buckets: int) -> pa.Table:
    key = table.column("bucket")[0].as_py()
    owner, place, h1, h2 = packed.unpack(table, HASH_BYTES, HASH_BYTES)
    if key >= 0:
        repeated, _ = _settle(h1, h2, owner)
        owner, place = owner[repeated], place[repeated]
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    return pa.Table.from_batches([packed.pack(packed.slot(owner, n_buckets), owner, place)], packed.ARROW)


def _spans(places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal repeats: overlapping or adjacent windows joined, as word positions [start, end)."""
    places = np.unique(places).astype(np.int64)
    cut = np.flatnonzero(np.diff(places) > window) + 1
    return places[np.append(0, cut)], places[np.append(cut - 1, len(places) - 1)] + window


def _cut(docs: pa.Table, removed: pa.Table, window: int, digest: bool) -> pa.Table:
    gone = _places(removed) if removed.num_rows else {}
    ids, n_words, n_removed, texts, spans = [], [], [], [], []
    for i, text in zip(docs.column("id"), docs.column("body")):
        i, raw = i.as_py(), text.as_py()
        words = raw.encode().split() if raw is not None else []
        n_words.append(len(words))
        places = gone.get(i)
        span = []
        if places is not None:
            start, end = _spans(places, window)
            span = [{"start": int(a), "end": int(b)} for a, b in zip(start, end)]
            kept = []
            at = 0
            for a, b in zip(start, end):
                kept += words[at:a]
                at = b
            kept += words[at:]
        else:
            kept = words
        n_removed.append(len(words) - len(kept))
        ids.append(i)
        spans.append(span)
        body = b" ".join(kept)
        if digest:
            texts.append(hashlib.sha256(body).hexdigest())
        else:
            texts.append(body.decode() if places is not None else raw)
    return pa.table(
        [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _SPANS), pa.array(texts, pa.string()), docs.column("rest")],
        names=["id", "n_words", "n_removed", "spans", "kept", "rest"],
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id long, n_words, n_removed, spans, kept, rest) of every row; ``rest`` is a struct of the columns in ``carry``.

    ``spans`` are the maximal repeats as word positions [start, end). ``kept`` is the text without them: unchanged where
    nothing was removed, else the kept words joined by one space. With ``digest`` it is the SHA-256 (lowercase hex) of
    the kept words joined by one space. ``window`` must be even; blocks have half of it.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be an even number of at least 4 words")
    spark, block = docs.sparkSession, window // 2
    small_batches(spark)
    scratch, total = Scratch(spark, "repeats"), text_bytes(docs, text_col)
    # Each bucket of documents sends a row to each bucket of windows, so the latter are fewer.
    n, n_windows = buckets(spark, total), buckets(spark, total, 1)
    own_id = F.coalesce(long_id(docs, id_col), F.lit(NO_ID)).alias("id")
    source = docs.select(own_id, F.col(text_col).cast("string").alias("body"))
    entries = source.mapInArrow(lambda it: _anchors(it, n, block), packed.SCHEMA)
    hits = scratch.keep(entries.groupBy("bucket").applyInArrow(tidy(lambda t: _meet(t, n, block)), packed.SCHEMA), "hits")
    del entries
    release(spark)
    rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(True).alias("_"))
    placed = docs.select(own_id, F.col(text_col).cast("string").alias("body"), rest.alias("rest"))
    placed = placed.select(slot_column("id", n).alias("bucket"), "id", "body", "rest")
    schema = T._parse_datatype_string("id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string").add("rest", placed.schema["rest"].dataType)
    texts = source.select(slot_column("id", n).alias("bucket"), "id", "body")
    windows = texts.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(tidy(lambda a, b: _candidates(a, b, n, n_windows, window, block)), packed.SCHEMA)
    removed = scratch.keep(windows.groupBy("bucket").applyInArrow(tidy(lambda t: _decide(t, n)), packed.SCHEMA), "removed")
    del windows
    scratch.drop("hits")
    release(spark)
    out = placed.groupBy("bucket").cogroup(removed.groupBy("bucket")).applyInArrow(tidy(lambda a, b: _cut(a, b, window, digest)), schema)
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID)))
