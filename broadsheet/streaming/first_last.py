"""First and last sighting per key over a stream of access rows.

``sightings`` is the stateful query: one running minimum and maximum per key. ``ingest`` keeps a snapshot table up to date
from micro-batches: each batch is combined with the current snapshot by one aggregate and written as a new version, and a
version is named by its batch, so a batch that is run again after a failure rewrites its own version only. The state is
what lies in the folder: a restart goes on from the last version below its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import snapshot
from broadsheet.operators.store import BUCKETS, Store
from broadsheet.scratch import checkpoint_dir


def stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream; a single file is taken from its folder by name."""
    at, fs = _folder(spark, path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def sightings(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(ts).alias("first_accessed"), F.max(ts).alias("last_accessed"), F.count("*").alias("n"))


def ingest(rows: DataFrame, key: str, ts: str, name: str) -> DataFrame:
    """Runs what is available to its end and returns the last snapshot (key, first_accessed, last_accessed). The key is a
    column; rows with a null key are kept under it."""
    spark = rows.sparkSession
    root = f"{checkpoint_dir(spark)}/broadsheet/{name}"
    first = rows.select(key, F.col(ts).alias("first_accessed"), F.col(ts).alias("last_accessed"))

    def batch(df: DataFrame, n: int) -> None:
        new = df.select(key, F.col(ts).alias("first_accessed"), F.col(ts).alias("last_accessed"))
        done = [v for v in versions(spark, root) if v < n]
        store = spark.read.schema(first.schema).parquet(f"{root}/v{done[-1]}") if done else new.limit(0)
        snapshot.upsert(store, new, key).write.mode("overwrite").parquet(f"{root}/v{n}")
        # The version before stays, for a batch that has to run again; older ones are not read any more.
        for v in done[:-1]:
            _delete(spark, f"{root}/v{v}")

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    done = versions(spark, root)
    reader = spark.read.schema(first.schema)
    return reader.parquet(f"{root}/v{done[-1]}") if done else spark.createDataFrame([], first.schema)


def ingest_buckets(rows: DataFrame, key: str, ts: str, name: str, buckets: int = BUCKETS) -> Store:
    """As :func:`ingest`, into a bucketed store: a batch rewrites the buckets of its keys only, and one that runs again after
    its version was made changes nothing. The store and the stream's progress lie in one folder and live and die together."""
    spark = rows.sparkSession
    root = f"{checkpoint_dir(spark)}/broadsheet/{name}"
    first = rows.select(key, F.col(ts).alias("first_accessed"), F.col(ts).alias("last_accessed"))

    def batch(df: DataFrame, n: int) -> None:
        store = Store(df.sparkSession, f"{root}/store", first.schema, key, buckets)
        store.upsert(df.select(key, F.col(ts).alias("first_accessed"), F.col(ts).alias("last_accessed")), n)
        store.vacuum()

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return Store(spark, f"{root}/store", first.schema, key, buckets)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that were written to their end, ascending."""
    at, fs = _folder(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in done if fs.exists(_folder(spark, f"{root}/v{v}/_SUCCESS")[0]))


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def latest(rows: DataFrame, key: str, ts: str, name: str) -> DataFrame:
    """Runs :func:`sightings` over what is available and returns its table; the state is Spark's own state store."""
    spark = rows.sparkSession
    root = f"{checkpoint_dir(spark)}/broadsheet/{name}"
    made = sightings(rows, key, ts)

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/v{n}")

    query = made.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    done = versions(spark, root)
    return spark.read.schema(made.schema).parquet(f"{root}/v{done[-1]}") if done else spark.createDataFrame([], made.schema)
