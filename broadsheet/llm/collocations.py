"""Phrases that occur together more often than their parts suggest, mined by hash-bucket passes with Apriori pruning.

Pass k reads the texts once. It counts exactly the k-grams that may be frequent, and deals the (k+1)-grams over hash buckets
whose counts are all it keeps of them. A k-gram may be frequent only if its bucket of the pass before has at least
``MIN_COUNT`` hits and if both (k-1)-grams in it are frequent; a (k+1)-gram is dealt only if both k-grams in it pass.
Both tests are bitmaps of ``2**bits`` places that travel to the tasks, however many grams there are: at most 16 MB each
(``MOST_BITS``). A full bitmap prunes less and changes no result, since what passes is counted exactly.

Counts are combined in each task and travel dealt by slices of the hash ring, packed: a frequent gram is one entry of a
flush, so no slice is hot. A slice is added up batch by batch; its memory follows its distinct grams, not their occurrences.
Counted grams travel as text, so counts do not depend on hashes.

Scores. A frequent phrase is cut in two at every place; the parts, being frequent too, are looked up in the tables of the
passes. Quotients are whole numbers from decimals. A phrase that lies inside a longer frequent one with nearly its count is
dropped. The best are taken by rank, at first in each task.

Cases: a null text is an empty one, a null language is ``und``. Repeated rows count as often as they occur. A piece
without words, a text without pieces and an empty table give nothing. Ties of score and count go by the bytes of the
phrase. Only the text and the language are read, whatever other columns are named. Memory in a task is bounded by the
longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm import packed
from broadsheet.llm.shared import Scratch, buckets, chunks, maybe_broadcast, small_batches, text_bytes
from broadsheet.llm.words import U64, Words, mix

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
#: A phrase goes if a longer one around it has at least this share (per cent) of its count.
COVERED = 80
UNKNOWN = "und"
#: Bits of a bucket number, by the bytes of text: a bitmap is 16 MB at most.
LEAST_BITS, MOST_BITS = 20, 27
MOST_SLICES = 1 << 16
#: Distinct grams, and bucket numbers, that a task holds before it sends them.
HELD_GRAMS, HELD_HITS = 400_000, 4_000_000
#: Bytes of text handled at a time.
STEP_BYTES = 4 << 20
#: Piece ends and further word separators (fixed by the contract of the query).
ENDS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_SEPARATOR = _END.copy()
_SEPARATOR[list(BLANKS)] = True
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240311)
_PLACE = _rng.integers(1, 2**62, 16, dtype=np.uint64) * U64(2) + U64(1)
ENTRIES = "slice int, keys array<string>, n array<long>, low binary, hits binary"
COUNTED = "slice int, kind int, lang string, phrase string, n long, buckets binary, frequent binary"
#: Kinds of rows that a pass leaves: frequent grams, words in a language, bitmaps of a slice.
GRAM, TOTAL, BITMAPS = 0, 1, 2


class Ring:
    """The ring of 64-bit hashes: its leading bits name a slice, a few more a place in the slice's bitmaps."""

    def __init__(self, slice_bits: int, bits: int):
        self.slice_bits, self.bits, self.place_bits = slice_bits, bits, bits - slice_bits

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def slice(self, bucket: np.ndarray) -> np.ndarray:
        return bucket >> self.place_bits

    def place(self, bucket: np.ndarray) -> np.ndarray:
        return bucket & ((1 << self.place_bits) - 1)


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _gram_hash(words: list[np.ndarray], langs: np.ndarray) -> np.ndarray:
    """Hash of grams given by the hashes of their words, column by column, and of their language."""
    total = langs.copy()
    for word, place in zip(words, _PLACE):
        total += word * place
    return mix(total + U64(len(words)))


class Chunk:
    """Words of a batch of texts: codes into a list of distinct words, hashes, piece numbers and languages."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        w = Words(texts, lower=True, separators=_SEPARATOR)
        data = _LOWER[w.data]
        ends = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int32)
        solid = data[~_SEPARATOR[data]]
        spelled = pa.Array.from_buffers(pa.string(), len(w.starts), [None, pa.py_buffer(ends), pa.py_buffer(solid)]).dictionary_encode()
        self.words, self.code = spelled.dictionary, spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hash = w.hash
        owner = w.owners()
        self.piece = np.cumsum(_END[data])[w.starts] + owner if len(data) else owner
        named = pc.fill_null(langs.cast(pa.string()), UNKNOWN).dictionary_encode()
        self.langs = named.dictionary
        self.lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        self.lang_hash = np.array([_language_hash(x) for x in self.langs.to_pylist()], U64)[self.lang] if len(owner) else np.zeros(0, U64)

    def inside(self, k: int) -> np.ndarray:
        """For each word, whether k words from it on lie in one piece."""
        out = np.zeros(len(self.code), bool)
        n = len(out) - k + 1
        if n > 0:
            out[:n] = self.piece[:n] == self.piece[k - 1 :]
        return out

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        return _gram_hash([self.hash[at + j] for j in range(k)], self.lang_hash[at])

    def distinct(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct k-gram (with its language) among the places ``at``, and how often it is there."""
        size = max(len(self.words), 1)
        key = self.lang[at] * size + self.code[at]
        for j in range(1, k):
            if j > 1:
                key, _ = pd.factorize(key)
            key = key * size + self.code[at + j]
        of, names = pd.factorize(key)
        first = np.zeros(len(names), np.int64)
        first[of[::-1]] = at[::-1]
        return first, np.bincount(of, minlength=len(names))

    def spelled(self, at: np.ndarray, k: int) -> pa.Array:
        """phrase, tab, language: neither words nor phrases hold a tab."""
        words = [self.words.take(pa.array(self.code[at + j])) for j in range(k)]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, " ")
        return pc.binary_join_element_wise(phrase, self.langs.take(pa.array(self.lang[at])), "\t")


def _set(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1 == 1


def _candidates(chunk: Chunk, k: int, ring: Ring, bitmaps: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Places of the k-grams that may be frequent."""
    at = np.flatnonzero(chunk.inside(k))
    if bitmaps is None or not len(at):
        return at
    dealt, frequent = bitmaps
    below = np.zeros(len(chunk.code), bool)
    shorter = np.flatnonzero(chunk.inside(k - 1))
    below[shorter] = _set(frequent, ring.bucket(chunk.hashes(shorter, k - 1)))
    at = at[below[at] & below[at + 1]]
    return at[_set(dealt, ring.bucket(chunk.hashes(at, k)))]


class _Held:
    """What a task has counted and not sent yet."""

    def __init__(self, ring: Ring, least: int):
        self.ring, self.cap = ring, least
        self.kind = np.uint8 if least < 256 else np.uint32
        self.grams: list[pa.Table] = []
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_grams = self.n_hits = 0

    def add(self, bucket: np.ndarray, keys: pa.Array, n: np.ndarray) -> None:
        self.grams.append(pa.table([pa.array(bucket), keys, pa.array(n.astype(np.int64))], names=["bucket", "key", "n"]))
        self.n_grams += len(keys)
        if self.n_grams > HELD_GRAMS:
            self.grams = [self._counted()]
            self.n_grams = len(self.grams[0])

    def hit(self, bucket: np.ndarray) -> None:
        of, names = pd.factorize(bucket)
        self.hits.append((names, np.bincount(of, minlength=len(names))))
        self.n_hits += len(names)

    def full(self) -> bool:
        return self.n_grams > HELD_GRAMS // 2 or self.n_hits > HELD_HITS

    def _counted(self) -> pa.Table:
        if not self.grams:
            return pa.table({"bucket": pa.array([], pa.int64()), "key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        return pa.concat_tables(self.grams).group_by(["bucket", "key"]).aggregate([("n", "sum")]).rename_columns(["bucket", "key", "n"])

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each slice; hits are cut off at the least count, beyond which only that it is reached matters."""
        grams = self._counted()
        grams = grams.sort_by("bucket")
        slices = self.ring.slice(grams.column("bucket").to_numpy())
        if self.hits:
            bucket, n = (np.concatenate(x) for x in zip(*self.hits))
            order = np.argsort(bucket, kind="stable")
            bucket, n = bucket[order], n[order]
            at = packed.runs(bucket)
            bucket, n = bucket[at], np.minimum(np.add.reduceat(n, at), self.cap).astype(self.kind) if len(at) else n.astype(self.kind)
        else:
            bucket, n = np.zeros(0, np.int64), np.zeros(0, self.kind)
        hit_slices = self.ring.slice(bucket)
        every = np.union1d(slices, hit_slices)
        if len(every):
            edges = np.searchsorted(slices, np.append(every, 1 << 62)).astype(np.int32)
            keys = grams.column("key").combine_chunks()
            counts = grams.column("n").combine_chunks()
            cut = np.searchsorted(hit_slices, np.append(every, 1 << 62))
            place = self.ring.place(bucket).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(every.astype(np.int32)),
                    pa.ListArray.from_arrays(edges, keys),
                    pa.ListArray.from_arrays(edges, counts),
                    pa.array([packed.planes(place[a:b], 3) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([packed.planes(n[a:b], n.dtype.itemsize) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                ],
                names=["slice", "keys", "n", "low", "hits"],
            )
        self.grams, self.hits, self.n_grams, self.n_hits = [], [], 0, 0


def _counts(batches: Iterator[pa.RecordBatch], k: int, last: bool, ring: Ring, least: int, bitmaps: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """One pass over (text, language): exact counts of k-grams, bucket hits of (k+1)-grams."""
    held = _Held(ring, least)
    for batch in chunks(batches, 0, STEP_BYTES):
        chunk = Chunk(batch.column(0), batch.column(1))
        at = _candidates(chunk, k, ring, bitmaps.value if bitmaps else None)
        if not len(at):
            continue
        one, n = chunk.distinct(at, k)
        held.add(ring.bucket(chunk.hashes(one, k)), chunk.spelled(one, k), n)
        if not last:
            may = np.zeros(len(chunk.code) + 1, bool)
            may[at] = True
            longer = at[may[at + 1]]
            longer = longer[chunk.inside(k + 1)[longer]]
            if len(longer):
                held.hit(ring.bucket(chunk.hashes(longer, k + 1)))
        if held.full():
            yield from held.rows()
    yield from held.rows()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _summed(batches: Iterator[pa.RecordBatch], k: int, ring: Ring, least: int) -> Iterator[pa.RecordBatch]:
    """The slice's frequent k-grams, its bitmaps, and in the first pass its number of words in each language."""
    hits = np.zeros(1 << ring.place_bits, np.int64)
    kind = np.uint8 if least < 256 else np.uint32
    held, size, number = [], 0, 0
    add = lambda tables: pa.concat_tables(tables).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])
    for batch in batches:
        number = batch.column("slice")[0].as_py()
        held.append(pa.table([pc.list_flatten(batch.column("keys")).cast(pa.string()), pc.list_flatten(batch.column("n"))], names=["key", "n"]))
        size += len(held[-1])
        if size > HELD_GRAMS:
            held = [add(held)]
            size = len(held[0]) // 2  # grows with what is distinct, so that most additions are worth it
        for low, n in zip(batch.column("low").to_pylist(), batch.column("hits").to_pylist()):
            hits[packed.unplanes(low, 3, np.uint32)] += packed.unplanes(n, np.dtype(kind).itemsize, kind)
    total = add(held)
    named = pc.split_pattern(total.column("key").combine_chunks(), "\t", max_splits=1)
    phrase, lang, n = pc.list_element(named, 0), pc.list_element(named, 1), total.column("n").combine_chunks()
    often = pc.greater_equal(n, least)
    phrase, lang, many = phrase.filter(often), lang.filter(often), n.filter(often)
    frequent = np.zeros(len(hits), bool)
    if len(phrase):
        w = Words(phrase, separators=_ONLY_SPACE)
        codes = lang.dictionary_encode()
        langs = np.array([_language_hash(x) for x in codes.dictionary.to_pylist()], U64)[codes.indices.to_numpy(zero_copy_only=False)]
        columns = w.hash.reshape(-1, k)
        frequent[ring.place(ring.bucket(_gram_hash([columns[:, j] for j in range(k)], langs)))] = True
    blank = lambda m, t: pa.nulls(m, t)

    def row(kinds: int, langs: pa.Array, phrases: pa.Array, counts: pa.Array, one: pa.Array, two: pa.Array) -> pa.RecordBatch:
        m = len(langs)
        columns = [pa.array([number] * m, pa.int32()), pa.array([kinds] * m, pa.int32()), langs, phrases, counts, one, two]
        return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in COUNTED.split(", ")])

    yield row(GRAM, lang, phrase, many, blank(len(lang), pa.binary()), blank(len(lang), pa.binary()))
    if k == 1:
        words = pa.table([pc.list_element(named, 1), n], names=["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
        m = len(words)
        yield row(TOTAL, words.column("lang").combine_chunks(), blank(m, pa.string()), words.column("n_sum").combine_chunks(), blank(m, pa.binary()), blank(m, pa.binary()))
    yield row(BITMAPS, blank(1, pa.string()), blank(1, pa.string()), blank(1, pa.int64()), pa.array([_bits(hits >= least)], pa.binary()), pa.array([_bits(frequent)], pa.binary()))


def _gathered(counted: DataFrame, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Both bitmaps of all slices: 2**bits bits each, whatever the number of grams."""
    rows = counted.where(F.col("kind") == BITMAPS).select("slice", "buckets", "frequent").toArrow()
    out = np.zeros((2, 1 << ring.slice_bits, (1 << ring.place_bits) // 8), np.uint8)
    for number, *both in zip(*(rows.column(c).to_pylist() for c in ("slice", "buckets", "frequent"))):
        for k in (0, 1):
            out[k, number] = np.frombuffer(both[k], np.uint8)
    return out[0].ravel(), out[1].ravel()


def frequent_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(k, lang, phrase, n) of every gram of up to ``longest`` words with ``least`` occurrences or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    total = text_bytes(docs, text_col)
    slice_bits = min(MOST_SLICES, buckets(spark, total)).bit_length()
    bits = max(slice_bits + 6, min(MOST_BITS, max(LEAST_BITS, (total // 8).bit_length())))
    ring, scratch = Ring(slice_bits, bits), Scratch(spark, "collocations")
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("body"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    tables, bitmaps = [], None

    def one_pass(k: int, bitmaps: Broadcast | None) -> DataFrame:
        entries = source.where("body is not null").mapInArrow(lambda it: _counts(it, k, k == longest, ring, least, bitmaps), ENTRIES)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _summed(batches, k, ring, least)

        return scratch.keep(entries.groupBy("slice").applyInArrow(summed, COUNTED), f"pass-{k}")

    for k in range(1, longest + 1):
        counted = one_pass(k, bitmaps)
        if bitmaps:
            bitmaps.destroy()
        if k < longest:
            bitmaps = spark.sparkContext.broadcast(_gathered(counted, ring))
        tables.append(counted)
    grams = None
    for k, counted in enumerate(tables, 1):
        own = counted.where(F.col("kind") == GRAM).select(F.lit(k).alias("k"), "lang", "phrase", "n")
        grams = own if grams is None else grams.union(own)
    words = tables[0].where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    return grams, words


def _whole(column: str) -> str:
    """A long that takes part in products beyond 64 bits."""
    return f"cast({column} as decimal(20, 0))"


def score(grams: DataFrame) -> DataFrame:
    """(k, lang, phrase, a, l, r, score) of every gram of two words or more: its lowest-scoring cut."""
    n = grams.count()
    parts = maybe_broadcast(grams.select("lang", F.col("phrase").alias("part"), F.col("n").alias("found")), n)
    cuts = grams.where("k > 1").select("k", "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substr(phrase, char_length(`left`) + 2)"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("found").alias(name)), ["lang", side])
    scored = cuts.withColumn("score", F.expr(f"(2000000 * {_whole('a')}) div ({_whole('l')} + {_whole('r')})"))
    least = scored.groupBy("k", "lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return least.select("k", "lang", "phrase", "a", "best.l", "best.r", "best.score")


def uncovered(grams: DataFrame, scored: DataFrame, covered: int = COVERED) -> DataFrame:
    """The scored phrases that no longer frequent phrase around them explains."""
    inside = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    longer = grams.where("k > 2").select("lang", F.explode(F.expr(inside)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    kept = scored.join(longer, ["lang", "phrase"], "left")
    return kept.where(f"around is null or 100 * {_whole('around')} < {covered} * {_whole('a')}").drop("around")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words."""
    grams, words = frequent_grams(docs, text_col, lang_col, least, longest)
    # A table of its own: the rank below would else repeat the joins above.
    scored = Scratch(docs.sparkSession, "phrases").keep(uncovered(grams, score(grams)), "scored")
    best_first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
