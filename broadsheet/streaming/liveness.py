"""When a headline leaves its page: stays of each key as a stream, closed by timers, with state that is freed.

A stay is a run of sightings each at most ``gap`` after the one before; a life is a run of stays of which each begins at most
``forget`` after the end of the one before. A stay is given out once, when the watermark has passed its end by ``gap``, with
the first sighting of its life and the sightings of the life so far. A key's state is freed when the watermark has passed its
last sighting by ``forget``; a key that comes back later begins a new life, as the batch form (:func:`stays`) has it. Rows may
come in any order within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from broadsheet.scratch import checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SECOND = 1_000_000

Stay = tuple[int, int, int]


def merged(stays: list[Stay], gap: int) -> list[Stay]:
    """Stays (first, last, sightings) in order, those at most ``gap`` apart made one."""
    out: list[Stay] = []
    for a, b, n in sorted(stays):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


def _collapse(gap: int):
    """Sightings of an Arrow batch as stays of its keys: what travels to a key's state grows with its stays, not its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((at, codes))
            codes, at = codes[order], at[order]
            begins = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (at[1:] - at[:-1] > gap)])
            ends = np.r_[begins[1:], len(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order[begins])), pa.array(at[begins]), pa.array(at[ends - 1]), pa.array(ends - begins)], names=["key", "first", "last", "n"])

    return run


class _Lives(StatefulProcessor):
    """State of a key: its life so far (first, last, sightings, timer), and the stays that may still grow."""

    def __init__(self, gap: int, forget: int):
        self.gap, self.forget = gap, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "first long, last long, n long, timer long")
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[Stay] = []
        for frame in rows:
            new = merged([*new, *zip(frame["first"].tolist(), frame["last"].tolist(), frame["n"].tolist())], self.gap)
        yield from self._move(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._move(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _move(self, key, new: list[Stay], watermark: int, fired: int = -1) -> Iterator[pd.DataFrame]:
        now = watermark * 1000
        first, last, n, timer = self.life.get() if self.life.exists() else (None, None, 0, -1)
        stays = merged([tuple(s) for s in self.open.get()] + new, self.gap)
        done = [s for s in stays if s[1] + self.gap < now]
        stays = stays[len(done) :]
        out = []
        for a, b, m in done:
            if last is None or a - last > self.forget:
                first, n = a, 0
            last, n = b, n + m
            out.append((key[0], first, last, n))
        ends = [s[1] + self.gap for s in stays[:1]] + ([last + self.forget] if last is not None else [])
        if timer >= 0 and timer != fired:
            self.handle.deleteTimer(timer)
        if not stays and (last is None or last + self.forget < now):
            self.life.clear()
            self.open.clear()
        else:
            # The next moment at which something ends that has not ended yet.
            due = min(e for e in ends if e >= now) // 1000 + 1
            self.handle.registerTimer(due)
            self.life.update((first, last, n, due))
            self.open.put(stays) if stays else self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "first_us", "last_us", "n"]).astype({"first_us": "int64", "last_us": "int64", "n": "int64"})

    def close(self) -> None:
        pass


def left(rows: DataFrame, key: str, ts: str, gap: int, forget: int, delay: int) -> DataFrame:
    """The stateful stream (key, first_accessed, last_accessed, n) of stays that have ended; times in seconds. Rows without
    a time are no sightings; a null key is a key."""
    kind = dict(rows.dtypes)[key]
    seen = rows.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    packed = seen.mapInArrow(_collapse(gap * _SECOND), f"key {kind}, first long, last long, n long")
    marked = packed.withColumn("mark", F.timestamp_micros("last")).withWatermark("mark", f"{delay} seconds")
    made = marked.groupBy("key").transformWithStateInPandas(_Lives(gap * _SECOND, forget * _SECOND), f"key {kind}, first_us long, last_us long, n long", "append", "eventTime")
    back = lambda c: F.timestamp_micros(c).cast(rows.schema[ts].dataType)
    return made.select(F.col("key").alias(key), back("first_us").alias("first_accessed"), back("last_us").alias("last_accessed"), "n")


def run_left(rows: DataFrame, key: str, ts: str, name: str, gap: int, forget: int, delay: int = 3600) -> DataFrame:
    """Runs what is available to its end and returns all stays given out so far; a restart under the same name goes on."""
    spark: SparkSession = rows.sparkSession
    root = f"{checkpoint_dir(spark)}/broadsheet/{name}"
    made = left(rows, key, ts, gap, forget, delay)
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        # The query takes a copy of the settings when it starts.
        query = made.writeStream.format("parquet").option("path", f"{root}/left").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, was) if was else spark.conf.unset(_PROVIDER)
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/left")


def stays(rows: DataFrame, key: str, ts: str, gap: int, forget: int, delay: int = 3600) -> DataFrame:
    """The batch form: the stays that the stream has given out when it has seen all rows."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    order = W.partitionBy(key).orderBy("_at")
    seen = rows.where(F.col(ts).isNotNull()).select(key, ts, at.alias("_at"))
    since = F.col("_at") - F.lag("_at").over(order)
    began = lambda most: F.sum((F.col("_since").isNull() | (F.col("_since") > most * _SECOND)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    cut = seen.withColumn("_since", since).withColumns({"_stay": began(gap), "_life": began(forget)})
    made = cut.groupBy(key, "_life", "_stay").agg(F.min(ts).alias("_first"), F.max(ts).alias("last_accessed"), F.max("_at").alias("_end"), F.count("*").alias("_n"))
    life = W.partitionBy(key, "_life")
    so_far = life.orderBy("_stay").rowsBetween(W.unboundedPreceding, 0)
    full = made.withColumns({"first_accessed": F.min("_first").over(life), "n": F.sum("_n").over(so_far)})
    now = seen.agg((F.max("_at") - delay * _SECOND).alias("_now"))
    return full.join(F.broadcast(now), F.col("_end") + gap * _SECOND < F.col("_now")).select(key, "first_accessed", "last_accessed", "n")  # one row
