"""Packed exchange: (hash, document, position) entries travel as byte columns, one row per task flush and hash bucket.

A row of a plain exchange costs 30 bytes for such an entry; packed and compressed it costs 7 to 9. Buckets follow the
number of shuffle partitions, so a bucket stays small however large the input is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries a task gathers before it writes them out.
FLUSH = 1_000_000


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, least significant plane first: like bytes lie together and compress."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int, dtype=np.uint64) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view(dtype).ravel()


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    new = np.empty(len(sorted_values), bool)
    new[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new)


SCHEMA = "bucket int, owners binary, lengths binary, places binary, h1 binary, h2 binary"
ARROW = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("owners", "lengths", "places", "h1", "h2"))])


def pack(bucket: np.ndarray, owner: np.ndarray, place: np.ndarray, h1: np.ndarray | None = None, h2: np.ndarray | None = None, width: int = 5) -> pa.RecordBatch:
    """One row per bucket. Entries of one owner should come together and in order of place."""
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    place = place[order] if len(place) else None
    h1 = h1[order] if h1 is not None else None
    h2 = h2[order] if h2 is not None else None
    starts = runs(bucket)
    ends = np.append(starts[1:], len(bucket))
    rows: list[list] = [[], [], [], [], [], []]
    for a, b in zip(starts, ends):
        own = owner[a:b]
        first = runs(own)
        rows[0].append(int(bucket[a]))
        rows[1].append(planes(own[first].astype(np.int64), 8))
        rows[2].append(planes(np.diff(np.append(first, b - a)).astype(np.uint32), 4))
        rows[3].append(planes(place[a:b].astype(np.uint32), 4) if place is not None else b"")
        rows[4].append(planes(h1[a:b], width) if h1 is not None else b"")
        rows[5].append(planes(h2[a:b], width) if h2 is not None else b"")
    return pa.RecordBatch.from_arrays([pa.array(r, t.type) for r, t in zip(rows, ARROW)], schema=ARROW)


def unpack(table: pa.Table, width: int = 5, width2: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, place, h1, h2 of all rows together."""
    owners, places, one, two = [], [], [], []
    for o, l, p, a, b in zip(*(table.column(n) for n in ("owners", "lengths", "places", "h1", "h2"))):
        owners.append(np.repeat(unplanes(o.as_py(), 8, np.int64), unplanes(l.as_py(), 4, np.uint32)))
        places.append(unplanes(p.as_py(), 4, np.uint32))
        one.append(unplanes(a.as_py(), width) if len(a.as_py()) else np.zeros(0, np.uint64))
        two.append(unplanes(b.as_py(), width2) if len(b.as_py()) else np.zeros(0, np.uint64))
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    return join(owners, np.int64), join(places, np.uint32), join(one, np.uint64), join(two, np.uint64)


_PRIME, _SPREAD = 2147483647, 48271


def slot(owner: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a document id; the same as :func:`slot_column` on the JVM side."""
    return (owner.astype(np.int64) % _PRIME * _SPREAD % _PRIME % n).astype(np.int32)


def slot_column(owner: str, n: int) -> Column:
    return F.expr(f"cast(pmod(pmod(pmod(`{owner}`, {_PRIME}L) * {_SPREAD}L, {_PRIME}L), {n}L) as int)")
