"""Most frequent grams against a plain count of all of them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import grams
from broadsheet.scratch import Scratch


def tokens():
    return F.split("text", " ")



def made(seed: int, docs: int = 80, vocabulary: int = 40) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    rows = [(k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(vocabulary)], k=rng.randrange(1, 40)))) for k in range(docs)]
    # Ids twice, without an id, without text, shorter than a gram.
    return [*rows, (1, "w0 w1 w2 w0 w1 w2"), (None, "w0 w1 w3"), (docs, None), (docs + 1, "w5"), (docs + 2, "w5 w6")]


def all_grams(text: str | None) -> list[str]:
    t = text.split(" ") if text else []
    return [" ".join(t[i : i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1)]


def plain(rows, n, least=0, most=None):
    freq, ids = Counter(), defaultdict(set)
    for i, text in rows:
        for g in all_grams(text):
            freq[g] += 1
            ids[g] |= {i} - {None}
    held = {g: f for g, f in freq.items() if most is None or least <= len(ids[g]) <= most}
    best = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:n]
    return [(g, f, *([len(ids[g])] if most is not None else [])) for g, f in best]


@pytest.mark.parametrize("n", [1, 7, 30, 200, 100_000])
def test_top_grams(spark, n):
    rows = made(n)
    df = spark.createDataFrame(rows, "id long, text string")
    assert [(r.term, r.freq) for r in grams.top_grams(df, tokens(), n).collect()] == plain(rows, n)


# The last bounds leave fewer words than are asked for, so no floor is known.
@pytest.mark.parametrize(("n", "least", "most"), [(10, 5, 50.0), (30, 2, 40.0), (60, 30, 60.0), (100_000, 3, 20.0)])
def test_bounded_by_documents(spark, n, least, most):
    rows = made(n)
    df = spark.createDataFrame(rows, "id long, text string")
    got = [(r.term, r.freq, r.df) for r in grams.top_grams(df, tokens(), n, "id", least, most).collect()]
    assert got == plain(rows, n, least, most) and got


def test_hits(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, "id long, text string")
    top = {g for g, _ in plain(rows, 25)}
    want = Counter()
    for i, text in rows:
        want[i] += sum(g in top for g in all_grams(text))
    found = grams.hits(df, ["id"], tokens(), grams.top_grams(df, tokens(), 25))
    assert {r.id: r.score for r in found.collect()} == {i: n for i, n in want.items() if n}


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    assert grams.top_grams(df, tokens(), 5).collect() == [] and grams.top_grams(df, tokens(), 5, "id", 2, 9.0).collect() == []
    assert grams.hits(df, ["id"], tokens(), grams.top_grams(df, tokens(), 5)).collect() == []


@pytest.mark.parametrize("bounds", [(), ("id", 5, 1_000.0)])
def test_only_grams_that_can_reach_the_floor_are_counted(spark, monkeypatch, bounds):
    """What is counted does not grow with the number of different pairs and triples."""
    rng = random.Random(5)
    rows = [(k, " ".join([f"w{rng.randrange(20)}" for _ in range(20)] + [f"x{k}_{i}" for i in range(30)])) for k in range(200)]
    kept, keep = {}, Scratch.keep

    def spy(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", spy)
    df = spark.createDataFrame(rows, "id long, text string")
    assert len(grams.top_grams(df, tokens(), 10, *bounds).collect()) == 10
    assert kept["of-2"] + kept["of-3"] < 500 and len({g for _, t in rows for g in all_grams(t)}) > 10_000
