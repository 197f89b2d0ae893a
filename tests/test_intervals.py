"""Similarity in half hours against a plain loop over them."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import pytest

from broadsheet.operators import intervals


def plain(rows, threshold):
    """{slot: newsiness}, {(slot, a, b)} of similar documents."""
    slots = sorted({s for _, _, b, e in rows if b is not None and e is not None for s in range(b, e + 1)})
    news, pairs = {}, set()
    for s in slots:
        docs = [(i, Counter(re.findall(r"\b\w\w+\b", (t or "").lower()))) for i, t, b, e in rows if b is not None and e is not None and b <= s <= e]
        n, df = len(docs), Counter(t for _, c in docs for t in c)
        vectors = {}
        for i, c in docs:
            w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            vectors[i] = {t: x / norm for t, x in w.items()} if norm else {}
        found = [(a, b) for a, b in itertools.combinations(sorted(vectors), 2) if round(sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()), 9) >= threshold]
        pairs |= {(s, a, b) for a, b in found}
        news[s] = 2 * len(found) / n**2 * 10000
    return news, pairs


def some_rows(seed, n=120, end=70):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)]
    rows = []
    for i in range(n):
        text = rng.choice(rows)[1] if rows and rng.random() < 0.3 else " ".join(rng.choice(words[: rng.choice([4, 25])]) for _ in range(rng.randint(1, 6)))
        b = rng.randrange(end)
        rows.append((i, text, b, b + rng.choice([-1, 0, 3, 20, 60])))
    return rows + [(900, None, 3, 9), (901, "", 3, 9), (902, "a !", 5, 6), (903, "only one word", None, 4)]


@pytest.mark.parametrize("seed, stretch, threshold", [(1, 24, 0.5), (2, 5, 0.5), (3, 1000, 0.5), (4, 24, 0.8)])
def test_newsiness_equals_a_plain_loop(spark, monkeypatch, seed, stretch, threshold):
    """Also with short stretches, one for all, and copies that come and go."""
    monkeypatch.setattr(intervals, "STRETCH", stretch)
    rows = some_rows(seed)
    found = intervals.Intervals(spark.createDataFrame(rows, "i long, t string, b long, e long"), "i", "t", "b", "e", threshold)
    want, pairs = plain(rows, threshold)
    assert {r.slot: round(r.newsiness, 6) for r in found.newsiness().collect()} == {s: round(x, 6) for s, x in want.items()}
    got = {(r.slot, r.a, r.b) for r in found.pairs().collect()}
    of = {}
    for i, t, b, e in sorted(rows, key=lambda r: r[0]):
        # The name of a class is its least document that is ever up.
        if b is not None and b <= e:
            of.setdefault(t or "", i)
    text = {i: t or "" for i, t, *_ in rows}
    assert got == {(s, *sorted((of[text[a]], of[text[b]]))) for s, a, b in pairs if text[a] != text[b]}


def test_half_hours_are_written_out_for_near_pairs_only(spark):
    """Headlines that are up for days and similar to nothing make no rows of half hours."""
    rows = [(i, f"word{i} thing{i} other{i}", 0, 200) for i in range(50)] + [(60, "two of a kind", 10, 12), (61, "two of one kind", 11, 14)]
    found = intervals.Intervals(spark.createDataFrame(rows, "i long, t string, b long, e long"), "i", "t", "b", "e")
    assert {(r.slot, r.a, r.b, r.p) for r in found.pairs().collect()} == {(11, 60, 61, 1), (12, 60, 61, 1)}
    assert found.scratch.spark.read.parquet(f"{found.scratch.root}/weights").select("rep").distinct().count() == 2


def test_no_headlines(spark):
    none = spark.createDataFrame([], "i long, t string, b long, e long")
    assert intervals.Intervals(none, "i", "t", "b", "e").newsiness().collect() == []


def test_blocks_are_compared_once_for_a_stretch(monkeypatch):
    """Not in every half hour, of which each has weights of its own."""
    import pyarrow as pa

    n, calls = 40, []
    rng = random.Random(4)
    terms = [rng.sample(range(30), 6) for _ in range(n)]
    spans = [(b := rng.randrange(20), rng.randrange(b + 1, 25)) for _ in range(n)]
    rows = pa.table({"stretch": [0] * n, "one": [0] * n, "two": [0] * n, "block": [0] * n, "rep": list(range(n)), "terms": terms, "tf": [[1] * 6] * n, "begins": [[b] for b, _ in spans], "ends": [[e] for _, e in spans], "counts": [[1]] * n})
    # The runs of the calendar (no term) and of each term.
    runs = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("term", "begin", "end", "value"), zip(*[(t, b, e, 1) for w, (b, e) in zip(terms, spans) for t in [None, *w]]))})
    whole = intervals.blocks.similar
    monkeypatch.setattr(intervals.blocks, "similar", lambda *a: calls.append(1) or whole(*a))
    got = {(k, *sorted((x, y))) for k, a, b, *_ in intervals._similar(rows, runs, 0.5, 24) for x, y in zip(a.to_pylist(), b.to_pylist())}
    texts = [(i, " ".join(f"w{t}" for t in w), b, e - 1) for i, (w, (b, e)) in enumerate(zip(terms, spans))]
    assert got == plain(texts, 0.5)[1] and len(got) > 10
    assert len(calls) == 1
