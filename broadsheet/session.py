"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Tables that the driver provides, one parquet each.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

#: Bytes of an Arrow batch between the JVM and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of Arrow batches to ``BATCH_BYTES`` where it was left at its default: ten thousand long
    documents at once would be held by the JVM and by the worker."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) in (_BATCH_DEFAULT, "64m", "64MB"):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def local_session(cores: int | str = 8, name: str = "broadsheet", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(conf.pop("shuffle", 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BROADSHEET_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables; columns and filters above reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
