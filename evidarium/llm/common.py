"""Helpers shared by the operators: shared scratch tables, packed input rows, SQL text normalisation."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators count it.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What a Python worker is handed at a time, where the session sets nothing: rows are counted by their bytes, as texts may
#: be long.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine may it be unset;
    a local folder is made then."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        base = getattr(spark.sparkContext, "_evidarium_scratch", None)
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext._evidarium_scratch = base
    return base.rstrip("/")


_recorders = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that this thread gives out meanwhile."""
    outer, paths = getattr(_recorders, "paths", None), []
    _recorders.paths = paths
    try:
        yield paths
    finally:
        _recorders.paths = outer
        if outer is not None:
            outer += paths


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_recorders, "paths", None) is not None:
        _recorders.paths.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The input's columns as one struct `record`, so that added columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """Back to the columns of the input."""
    return df.select(*[F.col(f"record.`{c}`").alias(c) for c in like.columns])


def with_text(docs: DataFrame, text_col: str, carry: list[str] | None) -> DataFrame:
    """record, the columns of docs or those of carry, and text for a Python worker: null where the record has it already.
    Workers take both back apart by texts_in, so that no text is sent twice."""
    if docs.sparkSession.conf.get(BATCH, None) is None:
        docs.sparkSession.conf.set(BATCH, BATCH_BYTES)
    columns = docs.columns if carry is None else carry
    text = F.lit(None).cast("string") if text_col in columns else F.col(f"`{text_col}`")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"), text.alias("text"))


def texts_in(batch: pa.RecordBatch, text_col: str) -> list[bytes]:
    """The texts of a batch of with_text as UTF-8, null as empty."""
    from .tokens import texts_of

    record = batch.column("record")
    at = record.type.get_field_index(text_col)
    return texts_of(record.field(at) if at >= 0 else batch.column("text"))


def one_blank(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")
