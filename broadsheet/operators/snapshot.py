"""Snapshots instead of row updates: upsert, touch, delete and topic reset as joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(key: str) -> Column:
    """A text key as it travels: 128 bits instead of the whole text. Null stays null and meets nothing."""
    return F.unhex(F.md5(F.col(key)))


def _against(batch: DataFrame, store: DataFrame, key: str, how: str) -> DataFrame:
    if batch.schema[key].dataType.typeName() != "string":
        return batch.join(store.select(key).distinct(), key, how)
    known = store.select(_digest(key).alias("_key")).distinct()
    return batch.withColumn("_key", _digest(key)).join(known, "_key", how).drop("_key")


def unseen(batch: DataFrame, store: DataFrame, key: str = "processed") -> DataFrame:
    """Rows of the batch whose key the store lacks."""
    return _against(batch, store, key, "left_anti")


def seen(batch: DataFrame, store: DataFrame, key: str = "processed") -> DataFrame:
    """Rows of the batch whose key the store holds."""
    return _against(batch, store, key, "left_semi")


def append(batch: DataFrame, path: str, key: str) -> DataFrame:
    """Adds the rows of the batch that the table at ``path`` lacks, one for each key, and returns the whole table."""
    spark = batch.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    one = batch.dropDuplicates([key])
    new = unseen(one, spark.read.schema(batch.schema).parquet(path), key) if there else one
    new.write.mode("append").parquet(path)
    return spark.read.schema(batch.schema).parquet(path)


def without_null(batch: DataFrame, key: str = "processed") -> DataFrame:
    """Rows whose key is not null; an empty text is one and stays until :func:`empties` are deleted."""
    return batch.where(F.col(key).isNotNull())


def empties(store: DataFrame, key: str = "processed") -> DataFrame:
    """Rows whose key is the empty text: those that a clean-up deletes."""
    return store.where(F.col(key) == "")


def upsert(store: DataFrame, batch: DataFrame, key: str, first: str = "first_accessed", last: str = "last_accessed") -> DataFrame:
    """Known keys keep their first sighting and take the batch's last one; new keys are added. Equal keys of a batch merge.

    Written as one aggregate over both sides: it combines before the shuffle, whatever a key's share of the rows.
    """
    both = store.select(key, first, last).unionByName(batch.select(key, first, last))
    return both.groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last))


def merge(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Insert or update by key: the batch's non-null values win."""
    rest = [c for c in store.columns if c != key]
    new = batch.select(key, *[F.col(c).alias(f"_{c}") for c in rest])
    return store.join(new, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])


def touch(store: DataFrame, batch: DataFrame, key: str, now: Column, last: str = "last_accessed") -> DataFrame:
    """Rows whose key the batch holds get a new last sighting."""
    keys = batch.select(key, F.lit(True).alias("_seen")).distinct()
    return store.join(keys, key, "left").withColumn(last, F.when(F.col("_seen"), now).otherwise(F.col(last))).drop("_seen").select(*store.columns)


def delete(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")


def reset(store: DataFrame, columns: list[str]) -> DataFrame:
    return store.withColumns({c: F.lit(None).cast(store.schema[c].dataType) for c in columns})
