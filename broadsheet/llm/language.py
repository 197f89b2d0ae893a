"""Language identification by interpolated Kneser-Ney character models.

Symbols are lower-case letters (16 bits; letters beyond the basic plane share one symbol) and one boundary for any run of
other characters. 4-gram counts of every training text are added up over the whole corpus (combined in each task before
the shuffle). From them come, per language, Kneser-Ney estimates: absolute discounts, continuation counts below the top
order, interpolation at every order. Discounts, continuation counts and context totals are aggregates over all grams, and
no gram is dropped.

The estimates are written by the tasks into the shared folder as sorted arrays, dealt by ranges of grams; only the list of
parts is shipped, and a task maps into memory the parts that its texts need. That folder must be mounted as files. A text
gets the language with the lowest cross-entropy per symbol; ties go to the language that sorts first.

Score and rejection are calibrated on labelled rows that the models have not learned from: a tenth of them by the hash of
their id, however many these are. What each of them scores stays distributed; sums and exact percentiles reach the driver. The
score is a logistic curve of the cross-entropy margin times the square root of the length. A text is rejected if it has no
letters, or if its cross-entropy lies further above the median of its language than nearly all (99.9 %) of the calibration
texts of its length band do, by more than the chance of so few symbols allows (``limits``).

Cases: a null text, or one without letters, is ``und`` with score 0 and rejected. Rows with a null label or id are not
learned from. With no labelled rows every text is ``und``; with fewer than LEAST_CALIBRATION for calibration, texts with
letters are not rejected. A language with fewer than LEAST_KEPT_OUT rows learns from all of them. Repeated rows get equal
answers. Only the id, text and label columns are read, so extra columns may have any name. Memory is bounded by the
longest text.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.packed import runs
from broadsheet.llm.shared import Scratch, chunks, mounted, small_batches
from broadsheet.llm.words import U64, mix

ORDER = 4
#: Rows (gram and language) of one stored part, and cells (gram times language) that scoring spreads out at a time.
PART_ROWS = 2_000_000
STEP_CELLS = 4_000_000
#: One labelled row in so many is kept out of the models for the calibration.
KEPT_OUT = 10
NEWTON_STEPS = 50
LEAST_CALIBRATION = 5
LEAST_KEPT_OUT = 20
#: Lengths, in symbols, at which the bands of the rejection limits begin.
BANDS = (0, 48, 160, 512, 2048)
#: A limit is at least this many times the median. It is wider by REACH / sqrt(symbols): the mean over n symbols varies with
#: the root of n, and four standard deviations of one symbol are about 15 nats.
LEAST_RATIO = 1.5
REACH = 15.0
_SPACE = 32
_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """Code point -> symbol; made once in each process."""
    if not _symbols:
        table = np.full(sys.maxunicode + 1, _SPACE, np.uint16)
        for c in range(sys.maxunicode + 1):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                table[c] = c if c < 0xFFFF else 0xFFFF
        _symbols.append(table)
    return _symbols[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all texts as 64-bit words, bounds of each text's grams, and each text's number of letters."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(lengths)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    s = _symbol_table()[raw]
    edge = np.concatenate([[0], np.cumsum(lengths)])
    letter = s != _SPACE
    keep = letter.copy()
    if len(s) > 1:
        keep[:-1] |= letter[1:]
    last = edge[1:][lengths > 0] - 1
    keep[last] = letter[last]
    total = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    kept = total[edge[1:]] - total[edge[:-1]]
    out = np.full(int(kept.sum()) + ORDER * n, _SPACE, np.uint16)
    shift = np.repeat(np.arange(n) * ORDER + ORDER - 1, kept)
    out[np.arange(len(shift)) + shift] = s[keep]
    counts = kept + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    g = np.zeros(max(len(out) - ORDER + 1, 0), U64)
    for k in range(ORDER):
        g <<= U64(16)
        g |= out[k : k + len(g)]
    # Grams that begin in the last three symbols of a text would run into the next one.
    valid = np.ones(len(g), bool)
    starts = np.concatenate([[0], np.cumsum(kept + ORDER)])
    for k in range(1, ORDER):
        at = starts[1:] - k
        valid[at[at < len(g)]] = False
    return g[valid], bounds, letters[edge[1:]] - letters[edge[:-1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), combined over the task; written out whenever two million grams have gathered."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (g, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])
        held.clear()

    for batch in chunks(batches):
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            g, _, _ = grams(batch.column(1).filter(pa.array(langs == lang)))
            g.sort()
            at = runs(g)
            g, c = g[at], np.diff(np.append(at, len(g)))
            if lang in held:
                g, c = np.concatenate([held[lang][0], g]), np.concatenate([held[lang][1], c])
                order = np.argsort(g, kind="stable")
                g, c = g[order], c[order]
                at = runs(g)
                g, c = g[at], np.add.reduceat(c, at)
            held[lang] = (g, c)
        if sum(len(g) for g, _ in held.values()) > 2_000_000:
            yield from rows()
    yield from rows()


class _Array:
    """A sorted array of hashes with a directory over the leading bits."""

    def __init__(self, keys: np.ndarray):
        h = mix(keys + U64(1))
        self.order = np.argsort(h)
        self.sorted = np.append(h[self.order], U64(2**64 - 1))
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        cells = np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)
        self.start = np.searchsorted(self.sorted[:-1], cells).astype(np.int32)
        self.longest = int(np.diff(np.append(self.start, len(keys))).max(initial=1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position in the key list, or -1."""
        h = mix(keys + U64(1))
        at = self.start[h >> U64(64 - self.bits)]
        got = self.sorted[at]
        behind = np.flatnonzero(got < h)
        for _ in range(self.longest):
            if not len(behind):
                break
            at[behind] += 1
            got[behind] = self.sorted[at[behind]]
            behind = behind[got[behind] < h[behind]]
        n = len(self.order)
        hit = (got == h) & (at < n)
        out = np.full(len(keys), -1, np.int64)
        out[hit] = self.order[at[hit]]
        return out


class Model:
    """Interpolated Kneser-Ney estimates of all languages, made from 4-gram counts in memory."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self._uncalibrated()
        keys: list[np.ndarray] = [np.zeros(0, U64)] * (ORDER + 1)
        freq: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        freq[ORDER] = [(g, c.astype(float)) for g, c in counts]
        for n in range(ORDER - 1, 0, -1):
            drop = U64((1 << (16 * n)) - 1)
            for g, _ in freq[n + 1]:
                # Continuation count: distinct grams of the next order that end in this one.
                u, c = np.unique(g & drop, return_counts=True)
                freq[n].append((u, c.astype(float)))
        for n in range(1, ORDER + 1):
            keys[n] = np.unique(np.concatenate([g for g, _ in freq[n]])) if langs else np.zeros(0, U64)
        width = len(langs)
        prob = np.full((1, width), 1.0 / 65536)
        self.grams: list[_Array | None] = [None]
        self.contexts: list[_Array | None] = [None]
        self.log: list[np.ndarray] = [np.log(prob)]
        self.weight: list[np.ndarray] = [np.zeros((0, width))]
        below = keys[1][:0]
        for n in range(1, ORDER + 1):
            contexts = np.unique(keys[n] >> U64(16))
            p, weight = np.zeros((len(keys[n]), width)), np.ones((len(contexts), width))
            for j, (g, c) in enumerate(freq[n]):
                if not len(g):
                    continue
                ones, twos = (c == 1).sum(), (c == 2).sum()
                discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones and twos else 0.75
                h = np.searchsorted(contexts, g >> U64(16))
                total = np.bincount(h, c, len(contexts))
                kinds = np.bincount(h, minlength=len(contexts))
                seen = total > 0
                weight[seen, j] = discount * kinds[seen] / total[seen]
                p[np.searchsorted(keys[n], g), j] = np.maximum(c - discount, 0) / total[h]
            h = np.searchsorted(contexts, keys[n] >> U64(16))
            lower = prob[np.searchsorted(below, keys[n] & U64((1 << (16 * (n - 1))) - 1))] if n > 1 else np.repeat(prob, len(keys[n]), 0)
            prob, below = p + weight[h] * lower, keys[n]
            self.grams.append(_Array(keys[n]))
            self.contexts.append(_Array(contexts))
            self.log.append(np.log(prob).astype(np.float32))
            self.weight.append(np.log(weight).astype(np.float32))

    def _uncalibrated(self) -> None:
        self.slope, self.offset = 1.0, 0.0
        self.median, self.excess = np.zeros(len(self.langs)), np.full(len(BANDS), np.inf)

    def limits(self, best: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Cross-entropy beyond which a text of this language and length is rejected."""
        median = self.median[best]
        band = np.searchsorted(BANDS, symbols, "right") - 1
        return np.maximum(LEAST_RATIO * median, median + self.excess[band]) + REACH / np.sqrt(np.maximum(symbols, 1))

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per symbol of each text under each language, its number of symbols, and of letters."""
        g, bounds, letters = grams(texts)
        rows = self.grams[ORDER].find(g)
        # One more row for grams that the top order does not hold; they are added from lower orders below.
        logs = np.concatenate([self.log[ORDER], np.zeros((1, len(self.langs)), np.float32)])
        sums = np.stack([np.add.reduceat(logs[:, j][rows], bounds[:-1], dtype=np.float64) for j in range(len(self.langs))], 1) if len(g) else np.zeros((len(texts), len(self.langs)))
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            doc = np.searchsorted(bounds, miss, "right") - 1
            value = np.zeros((len(miss), len(self.langs)))
            todo, key = np.arange(len(miss)), g[miss]
            for n in range(ORDER, 0, -1):
                key = key & U64((1 << (16 * n)) - 1) if n < ORDER else key
                row = self.grams[n].find(key) if n < ORDER else np.full(len(key), -1)
                hit = row >= 0
                value[todo[hit]] += self.log[n][row[hit]]
                todo, key = todo[~hit], key[~hit]
                context = self.contexts[n].find(key >> U64(16))
                known = context >= 0
                value[todo[known]] += self.weight[n][context[known]]
            value[todo] += self.log[0][0]
            for j in range(len(self.langs)):
                sums[:, j] += np.bincount(doc, value[:, j], len(texts))
        symbols = np.diff(bounds)
        return -sums / symbols[:, None], symbols, letters

    def margins(self, entropy: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = entropy.argmin(1)
        if entropy.shape[1] < 2:
            return best, np.full(len(best), 10.0)
        two = np.partition(entropy, 1, 1)
        return best, (two[:, 1] - two[:, 0]) * np.sqrt(symbols)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        entropy, symbols, letters = self.cross_entropies(texts)
        best, margin = self.margins(entropy, symbols)
        score = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))
        lowest = entropy[np.arange(n), best]
        none = letters == 0
        langs = ["und" if x else self.langs[b] for x, b in zip(none, best)]
        return langs, np.where(none, 0.0, score), np.where(none, 0.0, lowest), none | (lowest > self.limits(best, symbols))

    def calibrate(self, found: DataFrame) -> None:
        """Fits score and limits to all labelled texts with letters: what was found, by what margin, and whether it was right."""
        every = found.agg(F.count("*").alias("n"), F.count_if("right").alias("right"), F.percentile("margin", F.lit(0.5)).alias("margin")).first()
        if not self.langs or every.n < LEAST_CALIBRATION:
            return
        # Two more rows keep the curve finite where all are right.
        y, x = np.array([0.0, 1.0]), np.array([0.0, every.margin])
        a, b = 1.0, 0.0
        for _ in range(NEWTON_STEPS):
            z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) * F.col("margin") + F.lit(b)))
            rows = found.select(F.col("margin").alias("x"), F.col("right").cast("double").alias("y"), (1 / (1 + F.exp(-z))).alias("p")).withColumn("w", F.expr("p * (1 - p) + 1e-6"))
            s = np.array(rows.agg(*[F.sum(F.expr(e)) for e in ("(y - p) * x", "y - p", "w * x * x", "w * x", "w")]).first(), float)
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            s += [((y - p) * x).sum(), (y - p).sum(), (w * x * x).sum(), (w * x).sum(), w.sum()]
            step = np.linalg.solve(np.array([[s[2] + 1e-3, s[3]], [s[3], s[4]]]), np.array([s[0] - 1e-3 * a, s[1]]))
            a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
            if abs(step).max() < 1e-10:
                break
        # Sums depend on the order of partitions in their last digits.
        self.slope, self.offset = max(round(a, 9), 0.0), round(b, 9)
        if every.right < LEAST_CALIBRATION:
            return
        right = found.where("right")
        half = F.percentile("lowest", F.lit(0.5))
        own = {r.best: r.m for r in right.groupBy("best").agg(F.count("*").alias("n"), half.alias("m")).where(F.col("n") >= LEAST_CALIBRATION).collect()}
        whole = right.agg(half).first()[0]
        self.median = np.array([own.get(j, whole) for j in range(len(self.langs))])
        median = F.get(F.array(*[F.lit(float(m)) for m in self.median]), F.col("best"))
        band = sum((F.col("symbols") >= k).cast("int") for k in BANDS) - 1
        above = {r.band: r.q for r in right.groupBy(band.alias("band")).agg(F.percentile(F.col("lowest") - median, F.lit(0.999)).alias("q")).collect()}
        wider = 0.0
        # From long to short; a band with few rows has the limits of the longer one at least.
        for k in range(len(BANDS) - 1, -1, -1):
            wider = self.excess[k] = max(wider, above.get(k, 0.0))


class _Parts:
    """A stored table (gram, language) -> value, in parts that are mapped into memory when first read."""

    def __init__(self, parts: list[tuple[int, str]]):
        self.first, self.paths = np.array([f for f, _ in parts], np.int64), [p for _, p in parts]
        self.open: dict[int, list[np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "open": {}}

    def fill(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Sets out[k, language] for the ascending keys that the table holds; other cells stay."""
        cut = np.append(np.searchsorted(keys, self.first), len(keys))
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if a == b:
                continue
            if i not in self.open:
                self.open[i] = [np.load(f"{self.paths[i]}-{name}.npy", mmap_mode="r") for name in _ARRAYS]
            held, start, langs, values = self.open[i]
            at = np.searchsorted(held, keys[a:b])
            hit = np.flatnonzero(held[np.minimum(at, len(held) - 1)] == keys[a:b])
            begin, n = start[at[hit]], start[at[hit] + 1] - start[at[hit]]
            cells = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
            out[np.repeat(a + hit, n), langs[cells]] = values[cells]


class StoredModel(Model):
    """The same estimates over any number of grams, read from the shared folder."""

    def __init__(self, langs: list[str], grams_of: dict[int, _Parts], weights_of: dict[int, _Parts]):
        self.langs = langs
        self._uncalibrated()
        self.grams, self.weight = grams_of, weights_of

    def _logs(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of ascending grams under each language: their own, or those of the next order backed off to."""
        if n == 0:
            return np.full((len(keys), len(self.langs)), -np.log(65536), np.float32)
        suffixes, at = np.unique(keys & _mask(n - 1), return_inverse=True)
        out = self._logs(n - 1, suffixes)[at]
        contexts, at = np.unique((keys.view(U64) >> U64(16)).view(np.int64), return_inverse=True)
        weight = np.zeros((len(contexts), len(self.langs)), np.float32)
        self.weight[n].fill(contexts, weight)
        out += weight[at]
        self.grams[n].fill(keys, out)
        return out

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, bounds, letters = grams(texts)
        symbols = np.diff(bounds)
        keys, of = np.unique(g.view(np.int64), return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), symbols)
        sums = np.zeros((len(texts), len(self.langs)))
        step = max(1, STEP_CELLS // len(self.langs))
        for a in range(0, len(keys), step):
            logs = self._logs(ORDER, keys[a : a + step])
            at = slice(None) if len(keys) <= step else np.flatnonzero((of >= a) & (of < a + step))
            rows, owner = of[at] - a, doc[at]
            for j in range(len(self.langs)):
                sums[:, j] += np.bincount(owner, logs[:, j][rows], len(texts))
        return -sums / symbols[:, None], symbols, letters


_ARRAYS = ("keys", "starts", "langs", "values")


def _mask(n: int) -> np.int64:
    return np.int64((1 << (16 * n)) - 1)


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the rows of a task as sorted arrays; (name, first key, path) of each."""
    held = list(batches)
    if not held:
        return
    os.makedirs(folder, exist_ok=True)
    rows = pa.Table.from_batches(held)
    name, key, lang, value = (rows.column(c).to_numpy() for c in ("name", "key", "lang", "value"))
    for t in np.unique(name).tolist():
        own = np.flatnonzero(name == t)
        own = own[np.lexsort((lang[own], key[own]))]
        at = runs(key[own])
        arrays = (key[own][at], np.append(at, len(own)).astype(np.int64), lang[own].astype(np.int32), value[own].astype(np.float32))
        # A name for each attempt: a second one does not touch files that are being read.
        path = f"{folder}/{t}-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        for a, x in zip(_ARRAYS, arrays):
            np.save(f"{path}-{a}.npy", x)
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([int(arrays[0][0])], pa.int64()), pa.array([path])], names=["name", "first", "path"])


def _estimate(scratch: Scratch, counts: DataFrame, langs: list[str]) -> StoredModel:
    """Kneser-Ney estimates from (lang, gram, n), all as aggregates and joins over (language, gram)."""
    number = F.create_map(*[F.lit(x) for pair in zip(langs, range(len(langs))) for x in pair])
    level = {ORDER: counts.select(number[F.col("lang")].alias("lang"), "gram", "n")}
    for n in range(ORDER - 1, 0, -1):
        # Continuation count: distinct grams of the next order that end in this one.
        level[n] = scratch.keep(level[n + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_mask(n)))).alias("gram")).agg(F.count("*").alias("n")), f"level-{n}")
    kinds = None
    for n in level:
        own = level[n].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.count("*").alias("rows")).withColumn("order", F.lit(n))
        kinds = own if kinds is None else kinds.union(own)
    kinds = kinds.collect()
    stored, lower = None, None
    for n in range(1, ORDER + 1):
        discounts = {r.lang: min(max(r.ones / (r.ones + 2 * r.twos), 0.1), 0.95) if r.ones and r.twos else 0.75 for r in kinds if r.order == n}
        discount = F.create_map(*[F.lit(x) for pair in discounts.items() for x in pair])[F.col("lang")]
        rows = level[n].withColumns({"context": F.shiftrightunsigned("gram", 16), "suffix": F.col("gram").bitwiseAND(F.lit(int(_mask(n - 1))))})
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        contexts = scratch.keep(contexts.select("lang", "context", "total", (discount * F.col("kinds") / F.col("total")).alias("weight")), f"contexts-{n}")
        rows = rows.join(contexts, ["lang", "context"])
        rows = rows.withColumn("below", F.lit(1.0 / 65536)) if lower is None else rows.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
        lower = scratch.keep(rows.select("lang", "gram", p.alias("p")), f"p-{n}")
        for t, table in ((2 * n, lower.select(F.col("gram").alias("key"), "lang", F.log("p").alias("value"))), (2 * n + 1, contexts.select(F.col("context").alias("key"), "lang", F.log("weight").alias("value")))):
            table = table.select(F.lit(t).alias("name"), "*")
            stored = table if stored is None else stored.union(table)
    # A level has no more contexts than grams.
    n_parts = 1 + 2 * sum(r.rows for r in kinds) // PART_ROWS
    folder = mounted(f"{scratch.root}/model")
    written = stored.repartitionByRange(n_parts, "name", "key").mapInArrow(lambda it: _store(it, folder), "name int, first long, path string").collect()
    parts = {t: _Parts(sorted((r.first, r.path) for r in written if r.name == t)) for t in range(2, 2 * ORDER + 2)}
    scratch.drop(*[f"{name}-{n}" for n in range(1, ORDER + 1) for name in ("level", "contexts", "p")])
    return StoredModel(langs, {n: parts[2 * n] for n in level}, {n: parts[2 * n + 1] for n in level})


def _calibration(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(best, margin, lowest, right, symbols) of labelled texts with letters."""
    for batch in chunks(batches, 0):
        entropy, symbols, letters = model.cross_entropies(batch.column(0))
        best, margin = model.margins(entropy, symbols)
        right = np.array([model.langs[b] == y for b, y in zip(best, batch.column(1).to_pylist())], bool)
        rows = pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(margin), pa.array(entropy[np.arange(len(best)), best]), pa.array(right), pa.array(symbols)], names=["best", "margin", "lowest", "right", "symbols"])
        yield rows.filter(pa.array(letters > 0))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from every labelled row given but those kept out for the calibration."""
    spark = labelled.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "language")
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and body is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    large = [lang for lang, n in sizes.items() if n >= LEAST_KEPT_OUT]
    out = (F.pmod(F.xxhash64("id"), F.lit(KEPT_OUT)) == 0) & F.col("lang").isin(large)
    counts = rows.where(~out).select("lang", "body").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model = _estimate(scratch, counts, langs) if langs else Model([], [])
    scratch.drop("counts")
    if langs:
        schema = "best int, margin double, lowest double, right boolean, symbols long"
        found = scratch.keep(rows.where(out).select("body", "lang").mapInArrow(lambda it: _calibration(it, model), schema), "calibration")
        model.calibrate(found)
        scratch.drop("calibration")
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        langs, score, entropy, rejected = model.predict(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of every row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    return source.mapInArrow(lambda it: _predict(it, model), f"id {dict(source.dtypes)['id']}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            yield batch.filter(pa.array(~model.predict(batch.column(at))[3]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
