"""The bucketed store and stays on a page: what is rewritten, what survives, and the stream against the batch form."""

from __future__ import annotations

import os
import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from broadsheet.operators.store import Conflict, Store
from broadsheet.streaming import first_last, liveness

SCHEMA = "k string, first_accessed int, last_accessed int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def new(spark, tmp_path, buckets=8):
    return Store(spark, str(tmp_path / "store"), frame(spark, []).schema, "k", buckets)


def found(df):
    return {r.k: (r.first_accessed, r.last_accessed) for r in df.collect()}


def files(tmp_path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(tmp_path).rglob("data/*/bucket=*/*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    s = new(spark, tmp_path)
    assert s.read().count() == 0 and s.versions() == []
    s.upsert(frame(spark, [(f"k{i}", i, i) for i in range(40)] + [("k3", 1, 90)]))
    before = files(tmp_path)
    s.upsert(frame(spark, [("k7", 0, 99)]))
    after = files(tmp_path)
    assert {p: t for p, t in after.items() if p in before} == before and len(after) == len(before) + 1
    want = {f"k{i}": (i, i) for i in range(40)} | {"k3": (1, 90), "k7": (0, 99)}
    assert found(s.read()) == want
    # The version before is still there until it is cleared away, and only what the last one does not read goes.
    assert found(s.read(0))["k7"] == (7, 7)
    s.vacuum(1)
    assert len(files(tmp_path)) == len(before) and found(s.read()) == want and s.versions() == [1]
    assert found(s.look_up(frame(spark, [("k7", 0, 0), ("none", 0, 0)]))) == {"k7": (0, 99)}


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = new(spark, tmp_path)
    s.upsert(frame(spark, [("a", 1, 1), ("b", 2, 2)]))
    held = files(tmp_path)

    def die(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_commit", die)
    with pytest.raises(KeyboardInterrupt):
        s.upsert(frame(spark, [("a", 0, 9)]))
    monkeypatch.undo()
    assert found(s.read()) == {"a": (1, 1), "b": (2, 2)} and len(files(tmp_path)) > len(held)
    s.vacuum()
    assert files(tmp_path) == held


def test_two_writers_and_batches_that_run_again(spark, tmp_path):
    s = new(spark, tmp_path)
    assert s.upsert(frame(spark, [("a", 1, 1)]), 0) == 0
    with pytest.raises(Conflict):
        s._commit(0, {"buckets": 8, "batch": None, "folders": {}})
    assert found(s.read()) == {"a": (1, 1)}
    # The same batch of a stream again, and one without rows.
    assert s.upsert(frame(spark, [("a", 0, 5)]), 0) == 0 and found(s.read()) == {"a": (1, 1)}
    assert s.upsert(frame(spark, []), 1) == 1 and found(s.read()) == {"a": (1, 1)}
    # Another number of buckets does not deal the table anew.
    assert new(spark, tmp_path, 3).buckets == 8


def test_touch_delete_merge(spark, tmp_path):
    s = new(spark, tmp_path)
    s.upsert(frame(spark, [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), (None, 4, 4), ("", 5, 5)]))
    s.touch(frame(spark, [("a", 0, 0), ("a", 0, 0), ("x", 0, 0)]), F.lit(50))
    s.merge(frame(spark, [("b", None, 60), ("d", 7, 7)]))
    s.delete(spark.createDataFrame([("c",), ("",)], "k string"))
    assert found(s.read()) == {"a": (1, 50), "b": (2, 60), "d": (7, 7), None: (4, 4)}
    with pytest.raises(ValueError, match="outside"):
        s.change(frame(spark, [("a", 0, 0)]), lambda old, batch: frame(spark, [(f"z{i}", 0, 0) for i in range(30)]))


def test_stream_into_buckets(spark, tmp_path):
    path, name = str(tmp_path / "in"), f"test-{uuid.uuid4().hex}"
    put = lambda rows: spark.createDataFrame(rows, "k string, ts int").coalesce(1).write.mode("append").parquet(path)
    put([("a", 3), ("b", 1), ("a", 2)])
    put([("b", 7), ("c", 5)])
    schema = spark.createDataFrame([], "k string, ts int").schema
    go = lambda: found(first_last.ingest_buckets(first_last.stream(spark, path, schema, 1), "k", "ts", name, 4).read())
    assert go() == {"a": (2, 3), "b": (1, 7), "c": (5, 5)}
    put([("a", 9)])
    assert go() == {"a": (2, 9), "b": (1, 7), "c": (5, 5)} == go()


def plain_stays(rows, gap, forget, now):
    out = []
    for k in {k for k, _ in rows}:
        first = last = begin = None
        n = 0
        for t in sorted(t for key, t in rows if key == k):
            if last is not None and t - last > gap:
                out.append((k, first, last, n))
            if last is None or t - last > forget:
                first, n = t, 0
            last, n = t, n + 1
        out.append((k, first, last, n))
    return sorted((r for r in out if r[2] + gap < now), key=repr)


def test_stays_in_any_order_within_the_delay(spark, tmp_path):
    """Rows out of order, equal rows, a null key, a restart after every file: the stream equals the batch form and a loop."""
    rng = random.Random(5)
    rows = []
    for k in ("a", "b", None, ""):
        t = 0
        for _ in range(60):
            t += rng.choice([0, 1, 5, 30, 120, 400])
            rows.append((k, t))
    rows.append(("once", 10))
    # Each file holds what came within a stretch of time, shaken by less than the delay.
    shaken = sorted(rows, key=lambda r: r[1] + rng.random() * 39)
    path, name = str(tmp_path / "in"), f"test-{uuid.uuid4().hex}"
    gap, forget, delay = 60, 200, 40
    for i in range(0, len(shaken), 50):
        df = spark.createDataFrame(shaken[i : i + 50], "k string, s long").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
        schema = df.schema
        got = liveness.run_left(first_last.stream(spark, path, schema, 1), "k", "ts", name, gap, forget, delay)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows_of = lambda df: sorted((tuple(r) for r in df.select("k", seconds("first_accessed"), seconds("last_accessed"), "n").collect()), key=repr)
    want = plain_stays(rows, gap, forget, max(t for _, t in rows) - delay)
    assert rows_of(liveness.stays(spark.read.parquet(path), "k", "ts", gap, forget, delay)) == want
    assert rows_of(got) == want and len(want) > 20


def test_stays_without_rows(spark, tmp_path):
    none = spark.createDataFrame([("a", None)], "k string, ts timestamp_ntz")
    path = str(tmp_path / "in")
    none.write.parquet(path)
    assert liveness.run_left(first_last.stream(spark, path, none.schema), "k", "ts", f"test-{uuid.uuid4().hex}", 60, 200).count() == 0
    assert liveness.stays(none, "k", "ts", 60, 200).count() == 0
