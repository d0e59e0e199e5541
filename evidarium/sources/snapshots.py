"""A keyed table that is changed in place: rows in hash buckets, of which a batch of changes rewrites those it touches.

    root/table          buckets and keys
    root/data/version=V/_bucket=B    the rows of bucket B as version V left them
    root/manifest/version=V          which version of each bucket belongs to version V

A version is in force once its manifest is complete, so readers see all of a batch or nothing of it, and what a lost job
has written without a manifest is written again. Buckets that a batch leaves alone are named anew, not copied. There is one
writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import upsert

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Snapshot:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, keys, buckets

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType | str, keys: list[str], buckets: int = 256) -> Snapshot:
        """A new, empty table, or the one that root has already."""
        schema = spark.createDataFrame([], schema).schema
        table = cls(spark, root, schema, keys, buckets)
        if not table._exists("table/_SUCCESS"):
            spark.createDataFrame([(buckets, keys, schema.json())], "buckets int, keys array<string>, schema string").coalesce(1).write.mode("overwrite").json(f"{table.root}/table")
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Snapshot:
        made = spark.read.schema("buckets int, keys array<string>, schema string").json(f"{root.rstrip('/')}/table").first()
        return cls(spark, root, T.StructType.fromJson(json.loads(made["schema"])), list(made["keys"]), made["buckets"])

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        system, path = self._path(name)
        return system.exists(path)

    def _numbers(self, name: str, prefix: str) -> list[int]:
        """Of the folders prefixN in a folder, all N."""
        system, path = self._path(name)
        found = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(n.removeprefix(prefix)) for n in found if n.startswith(prefix))

    def versions(self) -> list[int]:
        """All versions that can be read, the last being in force."""
        return [v for v in self._numbers("manifest", "version=") if self._exists(f"manifest/version={v}/_SUCCESS")]

    def manifest(self, version: int) -> tuple[int | None, dict[int, int]]:
        """The batch that made a version, and the version of each bucket; as many rows as buckets at most."""
        rows = self.spark.read.schema("bucket int, version int, batch long").json(f"{self.root}/manifest/version={version}").collect()
        return next(r["batch"] for r in rows if r["bucket"] < 0), {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/version={v}/_bucket={b}" for b, v in held.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the one in force; no rows before the first."""
        versions = self.versions()
        if version is None and not versions:
            return self.spark.createDataFrame([], self.schema)
        if version is not None and version not in versions:
            raise ValueError(f"there is no version {version}: {versions}")
        return self._rows(self.manifest(versions[-1] if version is None else version)[1])

    def apply(self, changes: DataFrame, batch: int | None = None, merge: Merge | None = None, deleted: str | None = None) -> int:
        """Merge changes (the table's columns; others only serve the merge) and return the version in force then.

        merge takes the rows of the touched buckets and the changes and gives the new rows; without it, changes replace
        what they do not leave null (merge.upsert). Keys whose changes have a true `deleted` column go. Batches are
        numbered upwards: one with the number of the last, or a lower one, has been merged already and changes nothing.
        Null keys are equal; an empty batch makes a version that is like the one before."""
        versions = self.versions()
        last, held = self.manifest(versions[-1]) if versions else (None, {})
        if batch is not None and last is not None and batch <= last:
            return versions[-1]
        marked = changes.withColumn("_bucket", self._bucket())
        touched = {r[0] for r in marked.select("_bucket").distinct().collect()}  # at most self.buckets
        version = (versions[-1] if versions else 0) + 1
        kept = dict(held)
        if touched:
            old = self._rows({b: v for b, v in held.items() if b in touched})
            live = changes.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else changes
            new = (merge or self._upsert)(old, live)
            if deleted:
                gone = changes.where(F.coalesce(F.col(deleted), F.lit(False))).select(*[F.col(f"`{k}`").alias(f"_gone_{i}") for i, k in enumerate(self.keys)]).distinct()
                new = new.join(gone, [F.col(f"`{k}`").eqNullSafe(F.col(f"_gone_{i}")) for i, k in enumerate(self.keys)], "left_anti")
            rows = new.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).withColumn("_bucket", self._bucket())
            rows.repartition(len(touched), "_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.root}/data/version={version}")
            written = self._numbers(f"data/version={version}", "_bucket=")
            kept = {b: v for b, v in held.items() if b not in touched} | {b: version for b in written}
        listed = [(-1, version, batch if batch is not None else last), *((b, v, None) for b, v in kept.items())]
        self.spark.createDataFrame(listed, "bucket int, version int, batch long").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/version={version}")
        return version

    def _upsert(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        return upsert(old, changes.select(*[f"`{f.name}`" for f in self.schema]), self.keys).drop("merge_status")

    def rewritten(self, version: int) -> int:
        """How many buckets a version has written."""
        return len(self._numbers(f"data/version={version}", "_bucket="))

    def forget(self, keep: int = 1) -> None:
        """Versions but the last `keep` can't be read any more; rows that no other version names are deleted."""
        versions = self.versions()
        gone, stay = versions[:-keep], versions[-keep:]
        needed = {(v, b) for s in stay for b, v in self.manifest(s)[1].items()}
        for v in gone:
            system, path = self._path(f"manifest/version={v}")
            system.delete(path, True)
        for v in self._numbers("data", "version="):
            for b in self._numbers(f"data/version={v}", "_bucket="):
                if (v, b) not in needed and v <= stay[-1]:
                    system, path = self._path(f"data/version={v}/_bucket={b}")
                    system.delete(path, True)
