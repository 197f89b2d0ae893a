"""Scratch tables in the shared checkpoint folder: they cut lineage and survive the loss of executors.

Tables that no later step reads are dropped as soon as that is known; what the returned frames still read is deleted when the
driver's process ends, or earlier by :meth:`Scratch.end`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast; beyond them the join shuffles.
BROADCAST_BYTES = 16 << 20
#: What a value is counted as; others (text, lists, structs) as LONG_VALUE.
WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}
LONG_VALUE = 48


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one of our own only where the setting is absent (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="broadsheet-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/broadsheet/{name}-{uuid.uuid4().hex}"
        if not _roots:
            atexit.register(_delete_roots)
        _roots.append((spark.sparkContext._jvm, self.root))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def end(self) -> None:
        """Deletes the whole folder, once what was made of it is read no more."""
        self.drop("")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def passing_name(spark: SparkSession, name: str) -> str:
    """A name of its own for a store or stream in the checkpoint folder that ends with the driver's process."""
    return Scratch(spark, name).root.rsplit("/", 1)[1]


def passing_folder(spark: SparkSession, name: str) -> str:
    """The whole path of such a folder."""
    return Scratch(spark, name).root


_roots: list[tuple] = []


def _delete_roots() -> None:
    """At the end of the process; a JVM that is gone already has nobody left to read the tables either."""
    for jvm, root in _roots:
        try:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # noqa: BLE001  the gateway may be closed in several ways
            return


def row_bytes(df: DataFrame) -> int:
    """What a row of the frame is counted as."""
    fixed = {"long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8} | WIDTHS
    return sum(fixed.get(f.dataType.typeName(), LONG_VALUE) for f in df.schema.fields)


def maybe_broadcast(df: DataFrame, rows: float, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a side of counted rows whose width is known; a larger one is left to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes(df) <= most else df
