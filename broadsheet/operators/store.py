"""A table dealt by key hash into buckets: a change rewrites the buckets that it touches and no others.

A version is a manifest: a small file that names the folder of each bucket. New buckets are written beside the old ones, and
the version begins to hold when its manifest is renamed into place, so readers see the old version or the new one, and a
writer that dies leaves the old one. Two writers from the same version: the second rename fails, and its call with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from broadsheet.operators import snapshot

#: Buckets of a new table. What the driver holds of a table is one folder name for each.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Store:
    """The table under ``path``: ``schema`` with one row for each ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        made = self.versions()
        # A table keeps the number it began with.
        self.buckets = self._manifest(made[-1])["buckets"] if made else buckets

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        at, fs = self._at(f"versions/v{version}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _now(self) -> tuple[int, dict]:
        made = self.versions()
        return (made[-1], self._manifest(made[-1])) if made else (-1, {"buckets": self.buckets, "batch": None, "folders": {}})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        folders = (self._manifest(version) if version is not None else self._now()[1])["folders"]
        return self._rows(sorted(folders.values()))

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; only their buckets are read."""
        wanted = keys.select(self.key).distinct()
        _, manifest = self._now()
        touched = [r[0] for r in wanted.select(self.bucket().alias("b")).distinct().collect()]  # at most one for each bucket
        return self._rows([manifest["folders"][str(b)] for b in touched if str(b) in manifest["folders"]]).join(wanted, self.key, "left_semi")

    def change(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> int:
        """A new version in which the buckets of the batch's keys are what ``how(old rows, batch)`` makes of them.

        ``how`` may give rows of these keys only, or leave some out. ``number`` is the batch's place in a stream: a batch that
        a version holds already changes nothing. Returns the version.
        """
        version, manifest = self._now()
        if number is not None and manifest["batch"] is not None and manifest["batch"] >= number:
            return version
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())  # at most one for each bucket
        folders = dict(manifest["folders"])
        if touched:
            old = self._rows([folders[str(b)] for b in touched if str(b) in folders])
            name = uuid.uuid4().hex
            made = how(old, batch).select(*self.schema.names).withColumn("bucket", self.bucket())
            # One task writes a bucket's file; rows are few there, as each key has one.
            made.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            written = {n.split("=")[1] for n in self._names(f"data/{name}") if n.startswith("bucket=")}
            if not written <= {str(b) for b in touched}:
                raise ValueError("the change gave keys outside the buckets of its batch")
            folders = {b: f for b, f in folders.items() if int(b) not in set(touched)} | {b: f"{name}/bucket={b}" for b in written}
        self._commit(version + 1, {"buckets": self.buckets, "batch": manifest["batch"] if number is None else number, "folders": folders})
        return version + 1

    def _commit(self, version: int, manifest: dict) -> None:
        draft, fs = self._at(f"versions/.draft-{uuid.uuid4().hex}")
        final, _ = self._at(f"versions/v{version}.json")
        out = fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        nothing = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # Without the option to overwrite, a rename onto a file that is there fails.
            context.rename(context.makeQualified(draft), context.makeQualified(final), nothing)
        except Exception as e:
            fs.delete(draft, False)
            if version in self.versions():
                raise Conflict(f"version {version} of {self.path} was made by another writer") from e
            raise

    def upsert(self, batch: DataFrame, number: int | None = None, first: str = "first_accessed", last: str = "last_accessed") -> int:
        """Known keys keep their first sighting and take the last one; new keys are added. The batch is combined before it
        meets the store."""
        few = batch.groupBy(self.key).agg(F.min(first).alias(first), F.max(last).alias(last))
        return self.change(few, lambda old, new: snapshot.upsert(old, new, self.key, first, last), number)

    def merge(self, batch: DataFrame, number: int | None = None) -> int:
        """Insert or update by key: the batch's non-null values win. One row of the batch for each key."""
        return self.change(batch, lambda old, new: snapshot.merge(old, new, self.key), number)

    def touch(self, batch: DataFrame, now: Column, last: str = "last_accessed") -> int:
        return self.change(batch, lambda old, new: snapshot.touch(old, new, self.key, now, last))

    def delete(self, gone: DataFrame) -> int:
        return self.change(gone, lambda old, new: snapshot.delete(old, new, self.key))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes versions but the last ``keep``, and what no kept version reads: also what dead writers left behind. Not
        while another writer is at work."""
        made = self.versions()
        for v in made[:-keep]:
            at, fs = self._at(f"versions/v{v}.json")
            fs.delete(at, False)
        used = {f for v in made[-keep:] for f in self._manifest(v)["folders"].values()}
        for run in self._names("data"):
            for n in self._names(f"data/{run}"):
                if f"{run}/{n}" not in used and n.startswith("bucket="):
                    at, fs = self._at(f"data/{run}/{n}")
                    fs.delete(at, True)
            if not any(f.startswith(f"{run}/") for f in used):
                at, fs = self._at(f"data/{run}")
                fs.delete(at, True)
