"""File intake as a stream: new contents, once each within a watermark, merged into a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import upsert
from ..sources.snapshots import Snapshot


def new_contents(spark: SparkSession, path: str, schema: T.StructType, delay: str = "1 day") -> DataFrame:
    """A stream of manifest rows (sha256, seen_at, ...), a content once within the delay."""
    return spark.readStream.schema(schema).json(path).where("sha256 is not null").withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def merge_stream(stream: DataFrame, root: str, checkpoint: str, schema: T.StructType, buckets: int = 256) -> None:
    """Merge each batch into a snapshot (sources/snapshots.py) at root by sha256, filling what is blank. A batch rewrites the
    buckets that it touches; one that is run again changes nothing."""
    table = Snapshot.create(stream.sparkSession, root, schema, ["sha256"], buckets)

    def fill(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert(old, new, ["sha256"], mode="fill", sequence="seen_at" if "seen_at" in schema.names else None).drop("merge_status")

    save = lambda batch, number: table.apply(batch.select(*schema.names), number, fill) and None
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, size: str, delay: str) -> DataFrame:
    """Counts by window and kind of a stream or a table of events (ts, event_type)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
