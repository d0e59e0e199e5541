"""Change records that arrive late and in any order.

What counts is change_seq, not arrival. The last change to each field, and the last choice for each map, is kept by a
streaming aggregation whose state outlives the batches and has no watermark, as a record may come at any time; each batch's
new results go to a snapshot, where a later change is never replaced by an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import last_per
from ..operators.windows import first_per
from ..sources.snapshots import Snapshot

FIELDS = "id long, field string, change_seq long, value string"
CHOICES = "placement_id long, map_id long, change_seq long, id long"


def last_fields(changes: DataFrame) -> DataFrame:
    """changes (id, change_seq, fields), a table or a stream, as (id, field, change_seq, value): of several changes to a field the
    last, of those with one change_seq the greatest value, null being the least."""
    each = changes.select("id", "change_seq", F.explode("fields").alias("field", "value"))
    best = F.max(F.struct("change_seq", F.col("value").isNotNull().alias("some"), "value")).alias("best")
    return each.groupBy("id", "field").agg(best).select("id", "field", F.col("best.change_seq").cast("long").alias("change_seq"), "best.value")


def last_choices(choices: DataFrame) -> DataFrame:
    """choices (placement_id, map_id, id, change_seq), a table or a stream, as the last choice for each placement and map."""
    best = F.max(F.struct("change_seq", "id")).alias("best")
    return choices.groupBy("placement_id", "map_id").agg(best).select("placement_id", "map_id", F.col("best.change_seq").cast("long").alias("change_seq"), "best.id")


def later(keys: list[str]):
    """A merge for snapshots in which the greater change_seq stays, whichever side has it."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return last_per(old.unionByName(new.select(*old.columns)), keys, "change_seq")

    return merge


def keep_last(results: DataFrame, snapshot: Snapshot, checkpoint: str) -> None:
    """Run a stream of last_fields or last_choices over what has arrived and merge its results into a snapshot with the
    same columns. A batch that is run again changes nothing."""
    merge = later(snapshot.keys)
    save = lambda batch, number: snapshot.apply(batch, number, merge) and None
    results.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def with_fields(table: DataFrame, fields: DataFrame, columns: list[str]) -> DataFrame:
    """table with the values of last_fields, as merge.partial_update gives it for all changes at once."""
    maps = fields.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_fields"))  # a row's columns at most
    kinds = dict(table.dtypes)
    new = lambda c: F.when(F.map_contains_key("_fields", F.lit(c)), F.col("_fields")[c].try_cast(kinds[c])).otherwise(F.col(c))
    return table.join(maps, "id", "left").select(*[(new(c) if c in columns else F.col(c)).alias(c) for c in table.columns])


def with_choices(positions: DataFrame, choices: DataFrame) -> DataFrame:
    """positions after last_choices, as merge.set_current gives them for all choices at once."""
    pick = first_per(choices, ["placement_id", "map_id"], [F.desc("change_seq"), F.desc("id")]).select("placement_id", "map_id", F.col("id").alias("_pick"))
    out = positions.join(pick, ["placement_id", "map_id"], "left")
    mine, any_ = F.col("id").eqNullSafe(F.col("_pick")), F.col("_pick").isNotNull()
    changed = {"is_current": F.when(any_, mine.cast("int")).otherwise(F.col("is_current")), "status": F.when(any_ & mine, "active").otherwise(F.col("status"))}
    return out.withColumns(changed).select(*positions.columns)
