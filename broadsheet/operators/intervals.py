"""Similar headlines in every half hour, from intervals: a headline is not copied into the half hours in which it is up.

Weights of terms differ from half hour to half hour, as what is up differs, but the texts do not. So a headline travels once
for each stretch of ``STRETCH`` half hours in which it is up:

1. Equal texts are one class. How many members of a class, and of a term's headlines, are up is kept as running differences:
   +1 where an interval begins, -1 behind its end, added up over time.
2. The classes of a stretch are dealt into blocks, of which every two meet in a task (:mod:`blocks`), with the running counts of
   the terms. The task takes every weight at its largest in the half hours of the class. What is similar by these is compared
   once more in each half hour, with the weights of that half hour.
3. It returns how many pairs are similar in each half hour, or the pairs where they are asked for.

So what is shipped grows with headlines times stretches; half hours are written out only for similar pairs that are asked for,
and for the calendar itself. The comparisons grow with the square of what is up in a stretch.

Cases: an interval that ends before it begins is never up. A null text, or one without terms, counts as a headline that is
similar to nothing. Half hours in which nothing is up have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators import blocks
from broadsheet.operators.similarity import terms
from broadsheet.scratch import Scratch, maybe_broadcast

#: Half hours of one stretch.
STRETCH = 24
#: Digits to which a product is rounded before it is compared.
DIGITS = 9
#: Pairs that are compared in the half hours at a time, about.
MOST_PAIRS = 1 << 15


def slot_number(ts: Column | str) -> Column:
    """Half hours since 1970 of a time without zone."""
    return F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 30


def slot_time(slot: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (slot * 30).cast("int"), F.lit(0))


def steps(changes: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, begin, end, value): the running sum of changes (key, slot, d), from begin up to, not including, end; zeros go."""
    summed = changes.groupBy(*key, "slot").agg(F.sum("d").alias("d")).where("d <> 0")
    order = W.partitionBy(*key).orderBy("slot")
    run = summed.select(*key, F.col("slot").alias("begin"), F.lead("slot").over(order).alias("end"), F.sum("d").over(order).alias(value))
    return run.where(F.col(value) > 0)


def _slots(begin: str, end: str) -> Column:
    return F.explode(F.sequence(F.col(begin), F.col(end) - 1))


def _stretches() -> Column:
    return F.explode(F.sequence(F.floor(F.col("begin") / STRETCH), F.floor((F.col("end") - 1) / STRETCH)))


def _clipped(rows: DataFrame) -> DataFrame:
    """Rows (begin, end) once for each ``stretch``, cut to it and counted from its first half hour."""
    own = rows.withColumn("stretch", _stretches())
    first = F.col("stretch") * STRETCH
    return own.withColumn("begin", (F.greatest("begin", first) - first).cast("int")).withColumn("end", (F.least("end", first + STRETCH) - first).cast("int"))


def _running(at: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray, n: int, stretch: int) -> np.ndarray:
    """(half hour, n): the values of runs written out."""
    out = np.zeros((stretch + 1, n), np.int64)
    np.add.at(out, (begin, at), value)
    np.subtract.at(out, (end, at), value)
    return np.cumsum(out, 0)[:-1]


class _Side:
    """The classes of a block: terms in order, their counts, and how many members are up in each half hour."""

    def __init__(self, rows: pa.Table, numbers: np.ndarray, stretch: int):
        self.starts, tf = blocks.listed(rows.column("tf"))
        runs, begin = blocks.listed(rows.column("begins"))
        n = len(rows)
        self.sizes = np.diff(self.starts)
        row = np.repeat(np.arange(n), self.sizes)
        order = np.lexsort((numbers, row))
        self.row, self.numbers, self.tf = row, numbers[order], tf[order]
        at = np.repeat(np.arange(n), np.diff(runs))
        self.up = _running(at, begin, blocks.listed(rows.column("ends"))[1], blocks.listed(rows.column("counts"))[1], n, stretch)
        self.norms = np.ones(self.up.shape)

    def largest(self, slots: np.ndarray, idf, cut: float) -> blocks.Vectors:
        """Every weight at its largest in the half hours in which its class is up, so that products are bounds for all of them."""
        top = np.zeros(len(self.numbers))
        for k in slots:
            w = self.tf * idf(k, slice(None))[self.numbers]
            self.norms[k] = np.sqrt(np.add.reduceat(w * w, self.starts[:-1]))
            np.maximum(top, w * np.repeat((self.up[k] > 0) / self.norms[k], self.sizes), out=top)
        return blocks.Vectors(self.starts, self.numbers, top, cut)


def _gathered(found: Iterator, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, not many more than ``least`` of them at a time."""
    parts, held = [], 0
    for i, j, s in found:
        parts.append((i, j, s))
        held += len(i)
        if held >= least:
            yield blocks.joined(iter(parts))[:2]
            parts, held = [], 0
    if held:
        yield blocks.joined(iter(parts))[:2]


def _similar(rows: pa.Table, runs: pa.Table, theta: float, stretch: int) -> Iterator[tuple]:
    """(half hour, reps of one block and of the other, products, pairs of headlines) of a task. What is similar by the largest
    weights of the stretch is compared in each half hour."""
    a, b, same = blocks.sides(rows)
    if not len(a) or not len(b):
        return
    names, rank, (na, nb) = blocks.numbered(blocks.listed(a.column("terms"))[1], blocks.listed(b.column("terms"))[1])
    term, begin, end, value = (np.asarray(runs.column(c).fill_null(0)) for c in ("term", "begin", "end", "value"))
    whole = np.asarray(runs.column("term").is_null())
    place = np.minimum(np.searchsorted(names, term), len(names) - 1)
    known = ~whole & (names[place] == term)
    df = _running(rank[place[known]], begin[known], end[known], value[known], len(names), stretch)
    n = _running(np.zeros(whole.sum(), np.int64), begin[whole], end[whole], value[whole], 1, stretch)[:, 0]
    idf = lambda k, t: np.log((1 + n[k]) / (1 + df[k, t])) + 1
    slots, one, cut, slack = np.flatnonzero(n), _Side(a, na, stretch), blocks.REST * theta, 0.5 * 10.0**-DIGITS
    two = one if same else _Side(b, nb, stretch)
    x = one.largest(slots, idf, cut)
    y = x if same else two.largest(slots, idf, cut)
    width, first = len(names), rows.column("stretch")[0].as_py() * stretch
    keys = one.row * width + one.numbers
    for i, j in _gathered(blocks.similar(x, y, width, theta, 2 * slack, same), MOST_PAIRS):
        met = ((one.up[:, i] > 0) & (two.up[:, j] > 0)).any(0)
        i, j = i[met], j[met]
        at = blocks.spread(two.starts[j], two.sizes[j])
        pair, t = np.repeat(np.arange(len(i)), two.sizes[j]), two.numbers[at]
        sought = i[pair] * width + t
        held = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        both = keys[held] == sought
        pair, t, tf = pair[both], t[both], one.tf[held[both]] * two.tf[at[both]]
        for k in slots:
            p = one.up[k, i] * two.up[k, j]
            own = p[pair] > 0
            product = np.bincount(pair[own], tf[own] * idf(k, t[own]) ** 2, len(i)) / (one.norms[k, i] * two.norms[k, j])
            yes = (p > 0) & (product >= theta - slack)
            if yes.any():
                yield first + int(k), a.column("rep").take(pa.array(i[yes])), b.column("rep").take(pa.array(j[yes])), product[yes], p[yes]


class Intervals:
    """Headlines (id, text) that are up in the half hours from ``begin`` to ``end``, both included, as numbers."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, begin: str, end: str, threshold: float = 0.5, stopwords: list[str] | None = None):
        self.threshold, self.scratch = threshold, Scratch(docs.sparkSession, "intervals")
        self._pairs: DataFrame | None = None
        self._live: DataFrame | None = None
        keep = self.scratch.keep
        text = F.coalesce(F.col(text_col), F.lit(""))
        up = docs.where(F.col(begin) <= F.col(end)).select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text).alias("key"), F.col(begin).cast("long").alias("begin"), F.col(end).cast("long").alias("end"))
        made = up.groupBy("key").agg(F.min("id").alias("rep"), F.first("text").alias("text"))
        tokens = terms("text")
        counted = made.select("key", "rep", F.explode(tx.remove_stop(tokens, stopwords) if stopwords else tokens).alias("term"))
        self.terms = keep(counted.groupBy("key", "rep", "term").agg(F.count("*").alias("tf")), "terms")
        moves = F.explode(F.array(F.struct(F.col("begin").alias("slot"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("slot"), F.lit(-1).alias("d")))).alias("m")
        self.changes = keep(up.select("key", moves).groupBy("key", "m.slot").agg(F.sum("m.d").alias("d")).where("d <> 0"), "changes")
        # One row for each half hour of the calendar.
        whole = steps(self.changes, [], "n")
        self.calendar = keep(whole.select(_slots("begin", "end").alias("slot"), "n").withColumn("stretch", F.floor(F.col("slot") / STRETCH)), "calendar")
        self.n_slots = self.calendar.count()
        held = self.terms.select("key", "rep").distinct()
        self.classes = keep(steps(self.changes, ["key"], "c").join(held, "key").select("rep", "begin", "end", "c"), "classes")
        self.frequencies = keep(steps(self.changes.join(self.terms.select("key", "term"), "key").select("term", "slot", "d"), ["term"], "df"), "frequencies")

    def _stretched(self) -> DataFrame:
        """(stretch, rep, begins, ends, counts, terms, tf) of every class in each stretch in which it is up."""
        if self._live is None:
            entry = F.struct(F.xxhash64("term").alias("t"), F.col("tf").cast("long").alias("tf"))
            held = self.terms.groupBy("rep").agg(F.collect_list(entry).alias("v")).select("rep", F.col("v.t").alias("terms"), F.col("v.tf").alias("tf"))
            spans = _clipped(self.classes).groupBy("stretch", "rep").agg(F.collect_list(F.struct("begin", "end", F.col("c").cast("long").alias("c"))).alias("s"))
            live = spans.select("stretch", "rep", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"), F.col("s.c").alias("counts"))
            self._live = self.scratch.keep(live.join(held, "rep"), "live")
        return self._live

    def _meet(self, run, schema: str) -> DataFrame:
        """The rows that ``run`` makes of every two blocks of a stretch and its running counts."""
        live = self._stretched()
        per = live.groupBy("stretch").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("m"))
        most = per.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("stretches")).first()
        n_blocks = blocks.number_of(most.n or 0, most.m or 0, max(1, most.stretches))
        meetings = [(i, j) for i in range(n_blocks) for j in range(i, n_blocks)]
        every = F.explode(F.array(*[F.struct(F.lit(i).alias("one"), F.lit(j).alias("two")) for i, j in meetings])).alias("m")
        counted = self.frequencies.select(F.xxhash64("term").alias("term"), "begin", "end", F.col("df").cast("long").alias("value"))
        whole = self.calendar.select(F.lit(None).cast("long").alias("term"), F.col("slot").alias("begin"), (F.col("slot") + 1).alias("end"), F.col("n").cast("long").alias("value"))
        runs = _clipped(counted.unionByName(whole)).select("stretch", "term", "begin", "end", "value", every).select("stretch", "m.one", "m.two", "term", "begin", "end", "value")
        keys, tasks = ["stretch", "one", "two"], min(2_000, max(1, 2 * most.stretches * len(meetings)))
        one = blocks.dealt(live, F.col("rep"), n_blocks).repartition(tasks, *keys).groupBy(*keys)
        return one.cogroup(runs.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, schema)

    def pairs(self) -> DataFrame:
        """(slot, a, b, sim, p): similar classes in each half hour, and how many pairs of headlines they stand for."""
        if self._pairs is None:
            theta, stretch = self.threshold, STRETCH
            rep = self.terms.schema["rep"].dataType.simpleString()

            def run(rows: pa.Table, runs: pa.Table) -> pa.Table:
                none = rows.column("rep").slice(0, 0)
                parts = [pa.table({"slot": pa.array([], pa.int64()), "rep": none, "other": none, "sim": pa.array([], pa.float64()), "p": pa.array([], pa.int64())})]
                for slot, x, y, sim, p in _similar(rows, runs, theta, stretch) if len(rows) else ():
                    parts.append(pa.table({"slot": pa.array([slot] * len(sim), pa.int64()), "rep": x, "other": y, "sim": sim, "p": pa.array(p, pa.int64())}))
                return pa.concat_tables(parts)

            found = self._meet(run, f"slot long, rep {rep}, other {rep}, sim double, p long")
            # Each pair from both of its ends.
            turned = F.explode(F.array(F.struct("rep", "other"), F.struct(F.col("other").alias("rep"), F.col("rep").alias("other")))).alias("e")
            weights = self.scratch.keep(found.select("slot", "sim", "p", turned).select("slot", "e.rep", "e.other", F.round("sim", DIGITS).alias("sim"), "p"), "weights")
            self._pairs = weights.where("rep < other").select("slot", F.col("rep").alias("a"), F.col("other").alias("b"), "sim", "p")
        return self._pairs

    def _counted(self) -> DataFrame:
        """(slot, p): pairs of headlines in similar classes, added up for each task."""
        theta, stretch = self.threshold, STRETCH

        def run(rows: pa.Table, runs: pa.Table) -> pa.Table:
            sums: dict[int, int] = {}
            for slot, _, _, _, p in _similar(rows, runs, theta, stretch) if len(rows) else ():
                sums[slot] = sums.get(slot, 0) + int(p.sum())
            return pa.table({"slot": pa.array(list(sums), pa.int64()), "p": pa.array(list(sums.values()), pa.int64())})

        return self._meet(run, "slot long, p long")

    def newsiness(self) -> DataFrame:
        """(slot, newsiness): ordered similar pairs over the square of the number of headlines, times 10000."""
        inside = self.classes.where("c > 1").select(_slots("begin", "end").alias("slot"), F.expr("c * (c - 1) div 2").alias("p"))
        p = self._counted().unionByName(inside).groupBy("slot").agg(F.sum("p").alias("p"))
        joined = self.calendar.join(maybe_broadcast(p, self.n_slots), "slot", "left")
        return joined.select("slot", (F.try_divide(2 * F.coalesce("p", F.lit(0)), F.col("n") * F.col("n")) * 10000).alias("newsiness"))
