"""Catalog tables as Parquet with declared schemas: scans that tolerate older files, counts, manifests, drift reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType, present: bool = True) -> DataFrame:
    """The table in declared order; columns that older files lack are null, a table that is not there is empty."""
    return spark.read.schema(schema).parquet(f"{root}/{name}") if present else spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in order, missing ones as typed nulls, others dropped."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def drift(df: DataFrame, schema: T.StructType) -> list[tuple[str, str]]:
    """(column, problem) where a table differs from its declaration."""
    held = {f.name: f.dataType for f in df.schema}
    out = [(f.name, "missing") for f in schema if f.name not in held]
    out += [(f.name, f"{held[f.name].simpleString()} instead of {f.dataType.simpleString()}") for f in schema if f.name in held and held[f.name] != f.dataType]
    return out + [(n, "undeclared") for n in held if n not in schema.names]


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def write_manifest(df: DataFrame, path: str, order: list[Column | str], form: str = "csv") -> None:
    """df in order, as CSV that read_manifest gives back as it was: quotes are doubled, and blanks at the ends stay."""
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} if form == "csv" else {}
    df.orderBy(*order).write.mode("errorifexists").options(**kept).format(form).save(path)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


BLOBS = "sha256 string, content binary, batch string, prefix string"


def write_blobs(files: DataFrame, held: DataFrame | None, path: str) -> DataFrame:
    """Content-addressed store: files (sha256, content) whose digest is new are written once, parted by its first two
    digits. Returns the digests written, as they stand in the store."""
    fresh = files.select("sha256", "content").where("sha256 is not null")
    if held is not None:
        fresh = fresh.join(held.select("sha256"), "sha256", "left_anti")
    batch = uuid.uuid4().hex
    fresh = fresh.dropDuplicates(["sha256"]).withColumns({"batch": F.lit(batch), "prefix": F.left("sha256", F.lit(2))})
    fresh.write.mode("append").partitionBy("prefix").parquet(path)
    return files.sparkSession.read.schema(BLOBS).parquet(path).where(F.col("batch") == batch).select("sha256")


def reference_counts(images: DataFrame, column: str = "sha256") -> DataFrame:
    """How many images name each file."""
    return images.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("references"))


def released(images: DataFrame, deleted: DataFrame, column: str = "sha256") -> DataFrame:
    """The files that no image names any more once the ids of deleted are gone."""
    before = reference_counts(images, column)
    gone = reference_counts(images.join(deleted.select("id").distinct(), "id", "left_semi"), column).withColumnRenamed("references", "gone")
    return before.join(gone, column).where("references = gone").select(column)


def orphans(blobs: DataFrame, images: DataFrame) -> DataFrame:
    """Blobs that no image names."""
    return blobs.join(images.select("sha256"), "sha256", "left_anti")
