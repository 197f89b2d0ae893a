"""Similar rows block by block against all pairs, and what is written on the way."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest

from broadsheet.operators import blocks, intervals, similarity


def _written(scratch) -> set[str]:
    return set(os.listdir(scratch.root.removeprefix("file:").replace("//", "/")))


def _texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(i, " ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.randint(1, 9)))) for i in range(n)]


def _plain(weights):
    rows = {}
    for r in weights.collect():
        rows.setdefault(r.rep, {})[r.term] = r.weight
    return {(a, b): s for a, b in itertools.combinations(sorted(rows), 2) if (s := round(sum(x * rows[b].get(t, 0) for t, x in rows[a].items()), 9)) >= 0.5}


def test_blocks_equal_all_pairs_and_write_none_that_is_not_asked_for(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW_ROWS", 40)
    s = similarity.Similar(spark.createDataFrame(_texts(200), "id long, title string"), "id", "title")
    assert s.blocks.blocks > 3
    s.newsiness().collect()
    assert s.clusters(2).count() == 200
    # Before, every pair that might be similar was a row in a table, and every similar one in another.
    assert not _written(s.scratch) & {"pairs", "candidates", "entered"}
    want = _plain(s.weights)
    assert {(r.a, r.b): r.sim for r in s.pairs.collect()} == pytest.approx(want)
    copies = {r.rep: r.copies for r in s.classes.collect()}
    assert s.blocks.count().groupBy().sum("p").first()[0] == sum(copies[a] * copies[b] for a, b in want)
    # Links connect what pairs connect, with at most one for a row of a task.
    links = [(r.a, r.b) for r in s.blocks.links().collect()]
    n = len(copies)
    assert len(links) <= n * (s.blocks.blocks + 1) and set(map(lambda p: tuple(sorted(p)), links)) and _groups(links) == _groups(want)


def _groups(pairs):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    out: dict = {}
    for x in list(up):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def test_half_hours_in_blocks_write_no_pairs(spark, monkeypatch):
    rows = [(i, t, i % 20, i % 20 + 9) for i, t in _texts(120)]
    df = spark.createDataFrame(rows, "i long, t string, b long, e long")
    one = {r.slot: r.newsiness for r in intervals.Intervals(df, "i", "t", "b", "e").newsiness().collect()}
    monkeypatch.setattr(blocks, "FEW_ROWS", 15)
    found = intervals.Intervals(df, "i", "t", "b", "e")
    assert {r.slot: r.newsiness for r in found.newsiness().collect()} == pytest.approx(one) and len(one) == 29
    assert not _written(found.scratch) & {"pairs", "candidates", "weights", "bounded"}


def test_small_tables_of_products(monkeypatch):
    """Also where a list or a block is wider than the table of partial products."""
    rng = np.random.default_rng(5)
    n, v = 60, 30
    dense = np.where(rng.random((n, v)) < 0.3, rng.random((n, v)), 0)
    dense[:, 0] += 0.2
    dense /= np.sqrt((dense**2).sum(1, keepdims=True))
    starts = np.concatenate([[0], np.cumsum((dense > 0).sum(1))])
    row, term = np.nonzero(dense)
    names, _, (numbers,) = blocks.numbered(term)
    want = {(i, j) for i, j in itertools.combinations(range(n), 2) if dense[i] @ dense[j] >= 0.6}
    for cells in (7, 500, 4 << 20):
        monkeypatch.setattr(blocks, "CELLS", cells)
        x = blocks.Vectors(starts, numbers, dense[row, term], 0.3)
        got = [(int(i), int(j)) for a, b, _ in blocks.similar(x, x, len(names), 0.6, 1e-9, True) for i, j in zip(a, b)]
        assert set(got) == want and len(got) == len(want) > 20


def test_rows_travel_fewer_times():
    """Larger blocks where there are many rows, fewer ones where groups are tasks enough."""
    assert blocks.number_of(1_350_000, 45_000_000) <= 21
    assert blocks.number_of(50_000, 2_000_000, 36) == 1 < blocks.number_of(50_000, 2_000_000)


def test_links_of_many_tasks_become_one_for_each_row(spark):
    """Twenty tasks have linked every row to a row of their own."""
    links = [(a, 1_000 + t) for a in range(300) for t in range(20)] + [(2_000, 2_001)]
    got = [(r.a, r.b) for r in similarity.starred(spark.createDataFrame(links, "a long, b long"), []).collect()]
    assert len(got) == 300 + 19 + 1 and _groups(got) == _groups(links)


def test_components_run_their_edges_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from broadsheet.operators.components import components
    from broadsheet.scratch import Scratch

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).mapInArrow(count, "a long, b long")
    assert {r.label for r in components(edges, Scratch(spark, "once"), "x").collect()} == {0}
    assert seen.value == 50
