"""Bucket counts, release of shuffle files, and reading of text batches; scratch tables come from the library."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql import types as T

from broadsheet.scratch import Scratch, maybe_broadcast
from broadsheet.session import BATCH_BYTES, small_batches

__all__ = ["BATCH_BYTES", "CHUNK_BYTES", "Scratch", "buckets", "chunks", "long_id", "maybe_broadcast", "mounted", "release", "small_batches", "text_bytes", "tidy"]

#: Bytes of text that one vectorised step handles at a time; a longer text is handled whole, on its own.
CHUNK_BYTES = 2 << 20


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that nothing refers to any more; they would else wait for a chance GC."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, counted."""
    return df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0


#: Bytes of text that one hash bucket stands for, at most; a bucket is held by one task.
BUCKET_BYTES = 32 << 20


def buckets(spark: SparkSession, total_bytes: int, per_partition: int = 3) -> int:
    """Number of hash buckets of a packed exchange over ``total_bytes`` of text: a few for each shuffle partition, and
    more as soon as a bucket would stand for over ``BUCKET_BYTES``."""
    return max(per_partition * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-total_bytes // BUCKET_BYTES))


def long_id(df: DataFrame, id_col: str) -> Column:
    """The id column as a long; other than whole numbers would silently become null, so they are an error."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def mounted(root: str) -> str:
    """A folder of the shared storage as a path of the file system."""
    url = urlparse(root)
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"files are mapped into memory: {root} is not a mounted folder")
    return unquote(url.path) if url.scheme else root


def _trim() -> None:
    """Gives freed memory back, so that a reused worker does not carry the peak of one step into the next."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(decide: Callable, every: int = 16) -> Callable:
    """A function of grouped tables that gives freed memory back after every few groups."""
    calls = [0]

    def run(*tables: pa.Table) -> pa.Table:
        out = decide(*tables)
        calls[0] += 1
        if calls[0] % every == 0:
            _trim()
        return out

    # The workers look at the number of arguments.
    return (lambda a, b: run(a, b)) if decide.__code__.co_argcount == 2 else (lambda t: run(t))


def chunks(batches: Iterator[pa.RecordBatch], at: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about ``most`` bytes of the text in column ``at``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    _trim()
