"""Sparse vectors that are similar, block by block: nothing is written for a pair that only may be similar.

Rows are dealt into blocks by the hash of their id, and every two blocks meet in one task, so a row travels once for each
block. Inside a task the rarest terms of a row, as many as are needed so that the rest has a norm below a share of the
threshold, are entered into lists; partial products of what meets there, with a bound for the rest, leave few pairs, and these
are compared on all terms. A task returns pairs, or only what is asked of them: their number by copies, or links that connect
the same rows, at most one for each row.

The comparisons grow with the square of the rows; memory is bounded by two blocks and ``CELLS`` numbers. Terms are compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and terms of a block at most, and rows from which a block is parted so that more tasks share the work.
MOST_ROWS = 65_536
MOST_TERMS = 4_000_000
FEW_ROWS, FEW_BLOCKS = 4_096, 8
#: Numbers of a table of partial products, which stays in a core's cache, and rows of the block that it covers.
CELLS = 1 << 18
TILE_ROWS = 256
#: Norm of what is not entered, as a share of the threshold.
REST = 0.75
EPS = 1e-6


class Vectors:
    """Rows (``starts`` into ``terms`` and ``weights``); terms are numbers, the rarest first, and sorted in every row."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, cut: float):
        self.n, self.starts = len(starts) - 1, starts
        sizes = np.diff(starts)
        row = np.repeat(np.arange(self.n), sizes)
        order = np.lexsort((terms, row))
        self.terms, self.weights, self.row = terms[order], weights[order], row
        sums = np.concatenate([[0.0], np.cumsum(self.weights * self.weights)])
        rest = sums[starts[1:]].repeat(sizes) - sums[:-1]
        self.entered = rest >= cut * cut - EPS
        held = np.bincount(row[self.entered], minlength=self.n)
        self.left = np.sqrt(np.maximum(sums[starts[1:]] - sums[starts[:-1] + held], 0.0))
        self.norm = np.sqrt(sums[starts[1:]] - sums[starts[:-1]])


def numbered(*terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The terms of some blocks in order, their numbers (those with the fewest rows first), and the numbers in place of terms."""
    names, inverse, counts = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    cuts = np.cumsum([len(t) for t in terms])[:-1]
    return names, rank, np.split(rank[inverse], cuts)


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions first, first + 1, ... of every run."""
    before = np.cumsum(counts) - counts
    return np.repeat(first - before, counts) + np.arange(counts.sum())


def _parts(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries with at most that many positions, one entry at least."""
    total, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def similar(a: Vectors, b: Vectors, n_terms: int, theta: float, slack: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, product) of at least the threshold less the slack; of one block with itself, each pair once."""
    if not a.n or not b.n:
        return
    order = np.argsort(b.terms[b.entered], kind="stable")
    listed, weight = b.row[b.entered][order], b.weights[b.entered][order]
    first = np.searchsorted(b.terms[b.entered][order], np.arange(n_terms + 1))
    column = np.zeros(n_terms, np.int64)
    sizes, r = np.diff(b.starts), 0
    least, most, most_left = theta - EPS - slack, b.norm.max(), b.left.max()
    while r < a.n:
        rows = max(1, min(TILE_ROWS, CELLS // b.n, a.n - r))
        while rows > 1 and rows * (a.starts[r + rows] - a.starts[r]) > 4 * CELLS:
            rows //= 2
        lo, hi = a.starts[r], a.starts[r + rows]
        own, own_row, own_weight, entered = a.terms[lo:hi], a.row[lo:hi] - r, a.weights[lo:hi], a.entered[lo:hi]
        t, t_row, t_weight = own[entered], own_row[entered], own_weight[entered]
        counts = first[t + 1] - first[t]
        part = None
        for x, y in _parts(counts, CELLS):
            at = spread(first[t[x:y]], counts[x:y])
            sums = np.bincount(np.repeat(t_row[x:y] * b.n, counts[x:y]) + listed[at], np.repeat(t_weight[x:y], counts[x:y]) * weight[at], rows * b.n)
            part = sums if part is None else part + sums
        if part is not None:
            hit = np.flatnonzero(part >= least - max(a.left[r : r + rows].max() * most, most_left * a.norm[r : r + rows].max()))
            i, j = hit // b.n, hit % b.n
            # What is in only one of the lists, or in none, lies behind the cut of one of the rows.
            near = part[hit] + np.maximum(a.left[i + r] * b.norm[j], b.left[j] * a.norm[i + r]) >= least
            if same:
                near &= j > i + r
            i, j = i[near], j[near]
            if len(i):
                known = np.unique(own)
                column[known] = np.arange(1, len(known) + 1)
                dense = np.zeros((rows, len(known) + 1))
                dense[own_row, column[own]] = own_weight
                for x, y in _parts(sizes[j], CELLS):
                    at = spread(b.starts[j[x:y]], sizes[j[x:y]])
                    product = dense[np.repeat(i[x:y], sizes[j[x:y]]), column[b.terms[at]]] * b.weights[at]
                    found = np.add.reduceat(product, np.cumsum(sizes[j[x:y]]) - sizes[j[x:y]])
                    yes = found >= theta - slack
                    yield i[x:y][yes] + r, j[x:y][yes], found[yes]
                column[known] = 0
        r += rows


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same of n rows, at most one for each row."""
    label = np.arange(n)
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def listed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of a column of lists without nulls."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    starts = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(lists), np.int64))]) if len(lists) else np.zeros(1, np.int64)
    return starts.astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The two blocks of a task, and whether they are one."""
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    block = table.column("block")
    if one == two:
        return table, table, True
    return table.filter(pa.compute.equal(block, one)), table.filter(pa.compute.equal(block, two)), False


def number_of(rows: int, terms: int, groups: int = 1) -> int:
    """Blocks for so many rows and terms in the largest of some groups; more groups are tasks enough with fewer blocks."""
    few = next(b for b in range(1, FEW_BLOCKS + 1) if groups * b * (b + 1) >= FEW_BLOCKS * (FEW_BLOCKS + 1))
    return max(1, min(few, -(-rows // FEW_ROWS)), -(-rows // MOST_ROWS), -(-terms // MOST_TERMS))


def dealt(packed: DataFrame, key: Column, blocks: int) -> DataFrame:
    """Rows with their ``block``, once for each pair of blocks (``one``, ``two``) in which it meets another."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    copied = packed.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return copied.withColumn("one", F.least("block", "_other")).withColumn("two", F.greatest("block", "_other")).drop("_other")


class Blocks:
    """Rows (by, id, copies) of weights (by, id, term, weight) whose product reaches the threshold, rounded to ``digits``."""

    def __init__(self, weights: DataFrame, id_col: str, theta: float, by: list[str], scratch, digits: int = 9, copies: str | None = None):
        self.by, self.theta, self.digits, self.scratch = by, theta, digits, scratch
        entry = F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w"))
        stands = (F.first(copies) if copies else F.lit(1)).cast("long")
        grouped = weights.groupBy(*by, F.col(id_col).alias("id")).agg(F.collect_list(entry).alias("v"), stands.alias("copies"))
        self.packed = scratch.keep(grouped.select(*by, "id", "copies", F.col("v.t").alias("terms"), F.col("v.w").alias("weights")), "packed")
        per = self.packed.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("m"))
        most = per.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("groups")).first()
        self.blocks = number_of(most.n or 0, most.m or 0, max(1, most.groups))
        # More partitions than groups of tasks, so that few of them share one.
        self.tasks = min(2_000, max(1, 2 * most.groups * self.blocks * (self.blocks + 1) // 2))

    def _run(self, made: Callable[[pa.Table, pa.Table, Iterator], dict], schema: str) -> DataFrame:
        by, theta, slack = self.by, self.theta, 0.5 * 10.0**-self.digits
        keys = [*by, "one", "two"]

        def run(table: pa.Table) -> pa.Table:
            a, b, same = sides(table)
            (sa, ta), (sb, tb) = listed(a.column("terms")), listed(b.column("terms"))
            names, _, (na, nb) = numbered(ta, tb)
            cut = REST * theta
            x = Vectors(sa, na, listed(a.column("weights"))[1], cut)
            y = x if same else Vectors(sb, nb, listed(b.column("weights"))[1], cut)
            out = made(a, b, similar(x, y, len(names), theta, slack, same))
            rows = len(next(iter(out.values())))
            return pa.table({k: pa.repeat(table.column(k)[0], rows) for k in by} | out)

        meeting = dealt(self.packed, F.col("id"), self.blocks).repartition(self.tasks, *keys)
        head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType([self.packed.schema[k] for k in by]).fields)
        return meeting.groupBy(*keys).applyInArrow(run, f"{head}, {schema}" if head else schema)

    def pairs(self) -> DataFrame:
        """(by, a, b, sim), a < b."""
        kind = self.packed.schema["id"].dataType.simpleString()

        def made(a: pa.Table, b: pa.Table, found: Iterator) -> dict:
            i, j, s = joined(found)
            return {"x": a.column("id").take(pa.array(i)), "y": b.column("id").take(pa.array(j)), "sim": pa.array(s)}

        out = self._run(made, f"x {kind}, y {kind}, sim double")
        return out.select(*self.by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("sim", self.digits).alias("sim")).where(F.col("sim") >= self.theta)

    def links(self) -> DataFrame:
        """(by, a, b) that connect what the pairs connect, at most one for each row of a task."""
        kind = self.packed.schema["id"].dataType.simpleString()

        def made(a: pa.Table, b: pa.Table, found: Iterator) -> dict:
            same, n, i, j = a is b, len(a), np.zeros(0, np.int64), np.zeros(0, np.int64)
            size = n if same else n + len(b)
            for x, y, _ in found:
                i, j = np.concatenate([i, x]), np.concatenate([j, y if same else y + n])
                if len(i) > CELLS:
                    i, j = forest(i, j, size)
            i, j = forest(i, j, size)
            ids = a.column("id") if same else pa.chunked_array(a.column("id").chunks + b.column("id").chunks)
            return {"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))}

        return self._run(made, f"a {kind}, b {kind}")

    def count(self) -> DataFrame:
        """(by, p): pairs by the copies of both ends, added up for each task."""

        def made(a: pa.Table, b: pa.Table, found: Iterator) -> dict:
            ca, cb = np.asarray(a.column("copies")), np.asarray(b.column("copies"))
            return {"p": pa.array([int(sum(int((ca[i] * cb[j]).sum()) for i, j, _ in found))], pa.int64())}

        return self._run(made, "p long")


def joined(found: Iterator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(found)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts))
