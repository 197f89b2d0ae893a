"""Micro-batches: several of them, a batch that runs again, a restart, and a folder without rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from broadsheet.operators import snapshot
from broadsheet.scratch import checkpoint_dir
from broadsheet.streaming import first_last

SCHEMA = "k string, ts int"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, name):
    rows = first_last.stream(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)
    return {r.k: (r.first_accessed, r.last_accessed) for r in first_last.ingest(rows, "k", "ts", name).collect()}


def test_batches_and_restarts(spark, tmp_path):
    path, name = str(tmp_path / "in"), f"test-{uuid.uuid4().hex}"
    put(spark, path, [("a", 3), ("b", 1), ("a", 2)])
    put(spark, path, [("b", 7), ("c", 5)])
    assert run(spark, path, name) == {"a": (2, 3), "b": (1, 7), "c": (5, 5)}
    # Nothing new.
    assert run(spark, path, name) == {"a": (2, 3), "b": (1, 7), "c": (5, 5)}
    # A restart with new rows goes on from what is stored.
    put(spark, path, [("d", 1), ("a", 9)])
    put(spark, path, [("e", 4)])
    want = {"a": (2, 9), "b": (1, 7), "c": (5, 5), "d": (1, 1), "e": (4, 4)}
    assert run(spark, path, name) == want
    # A version that was begun and not finished is written again by its batch.
    root = f"{checkpoint_dir(spark)}/broadsheet/{name}"
    last = first_last.versions(spark, root)[-1]
    first_last._delete(spark, f"{root}/v{last}/_SUCCESS")
    first_last._delete(spark, f"{root}/progress/commits/{last}")
    assert run(spark, path, name) == want and first_last.versions(spark, root)[-1] == last


def test_stream_without_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert run(spark, path, f"test-{uuid.uuid4().hex}") == {}


def test_state_store_counts(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([("a", 3)], [("a", 1), ("b", 2)], [("a", 8)]):
        put(spark, path, part)
    rows = first_last.stream(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)
    got = first_last.latest(rows, "k", "ts", f"test-{uuid.uuid4().hex}").collect()
    assert {(r.k, r.first_accessed, r.last_accessed, r.n) for r in got} == {("a", 1, 8, 3), ("b", 2, 2, 1)}


def test_append_adds_each_key_once(spark, tmp_path):
    path = str(tmp_path / "store")
    one = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "key string, n int")
    assert snapshot.append(one, path, "key").count() == 2
    two = spark.createDataFrame([("y", 5), ("z", 3)], "key string, n int")
    got = snapshot.append(two, path, "key").select("key", "n").collect()
    assert sorted((r.key, r.n) for r in got) == [("x", 1), ("y", 2), ("z", 3)]


def test_text_keys_meet_by_digest(spark):
    store = spark.createDataFrame([("a b",), (None,)], "processed string")
    batch = spark.createDataFrame([("a b", 1), ("c", 2), (None, 3), ("", 4)], "processed string, n int")
    assert {r.n for r in snapshot.unseen(batch, store).collect()} == {2, 3, 4}
    assert {r.n for r in snapshot.seen(batch, store).collect()} == {1}
    assert {r.n for r in snapshot.without_null(batch).collect()} == {1, 2, 4}
    assert {r.n for r in snapshot.empties(batch).collect()} == {4}
    assert snapshot.delete(batch, snapshot.empties(batch), "n").where(F.col("n") == 4).count() == 0


PAGE = '<a href="/2024/03/02/one">First headline here</a><a href="/2024/03/02/two">Second headline here</a><a href="/2024/03/02/two">Second headline here</a><a href="/2024/03/02/x">single</a><a href="/about">About this page</a>'
LATER = '<a href="/2024/03/02/two">Second headline here</a><a href="/2024/03/02/two">Another wording of two</a><a href="/2024/03/02/three">Third headline here</a>'


def test_stream_of_front_pages_into_the_store(spark):
    """Several offsets from a local server: a restart goes on where it was, and no half hour is fetched twice."""
    import http.server
    import json
    import threading
    import time

    from broadsheet.sources.front_pages import FrontPages
    from broadsheet.sources.html import Rule
    from broadsheet.streaming import pages

    served = {"page": PAGE, "n": 0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            served["n"] += 1
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(served["page"].encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, name = f"http://127.0.0.1:{server.server_port}", f"test-{uuid.uuid4().hex}"
    spark.dataSource.register(FrontPages)
    agencies = json.dumps([{"agency": "A", "url": base + "/ok"}, {"agency": "B", "url": base + "/gone"}])
    rules = [Rule("A", r"all a ;; href=/\d{4}/\d{2}/\d{2}/", need="link")]

    def run(every):
        stream = spark.readStream.format("front_pages").option("agencies", agencies).option("every", every).load()
        store, counted = pages.ingest(stream, rules, name)
        return store.collect(), {(r.batch, r.agency): (r.found, r.articles, r.headlines, r.updated) for r in counted.collect()}

    store, counted = run(1)
    # A known headline, one twice on the page, one of a single word, and a link that the rule does not want.
    assert len(store) == 2 and list(counted.values()) == [(4, 2, 2, 0)]
    before = {r.processed: r for r in store}
    served["page"] = LATER
    time.sleep(1.1)
    store, counted = run(1)
    assert len(store) == 4 and sorted(counted.values()) == [(3, 1, 2, 1), (4, 2, 2, 0)]
    after = {r.processed: r for r in store}
    # What left the page keeps its last sighting, what stays gets a new one, and first sightings stay.
    moved = [p for p, r in before.items() if after[p].last_accessed > r.last_accessed]
    assert len(moved) == 1 and "econd" in moved[0] and all(after[p].first_accessed == r.first_accessed for p, r in before.items())
    fetched = served["n"]
    # The same offset again: stretches so long that none has passed.
    again, _ = run(10**9)
    server.shutdown()
    assert served["n"] == fetched and {r.processed for r in again} == set(after)


def test_day_report(spark):
    from broadsheet.streaming import pages

    counted = spark.createDataFrame([("A", 9, 1, 2, 3, 0), ("A", 9, 1, 0, 5, 1), ("B", 1, 0, 0, 0, 0)], "agency string, found long, articles long, headlines long, updated long, batch int")
    errors = spark.createDataFrame([("B", "timed out"), ("B", "timed out"), ("C", "404"), ("A", None)], "agency string, error string")
    got = {r.agency: (r.line, r.exceptions) for r in pages.day_report(counted, errors).collect()}
    assert got == {"A": ("A: (2,2,8)", []), "B": ("B: (0,0,0)", ["timed out"]), "C": ("C: (0,0,0)", ["404"])}
