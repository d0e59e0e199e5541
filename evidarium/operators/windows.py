"""One row per group: elections, re-elections and rankings. row_number with a group limit is cut before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    numbered = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank or "_rank") <= n)
    return numbered if rank else numbered.drop("_rank")


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("created_at"), F.desc("id")]


def current_positions(positions: DataFrame) -> DataFrame:
    """The position in force of each placement: marked current, newest, highest id."""
    return first_per(positions.where("is_current = 1"), ["placement_id"], newest_first())


def replacement_positions(positions: DataFrame, deleted: DataFrame) -> DataFrame:
    """After the ids of deleted are gone: where a current position went, the newest active one of its placement and map."""
    gone = positions.join(deleted.select("id"), "id", "left_semi").where("is_current = 1").select("placement_id", "map_id").distinct()
    left = positions.join(deleted.select("id"), "id", "left_anti").where("status = 'active'")
    return first_per(left.join(gone, ["placement_id", "map_id"], "left_semi"), ["placement_id", "map_id"], newest_first())


def family_primaries(members: DataFrame) -> DataFrame:
    return first_per(members, ["family_id"], [F.desc_nulls_last("is_primary"), F.asc_nulls_first("sort_order"), F.asc("id")])


def canonical_files(files: DataFrame, score: Column) -> DataFrame:
    """Of files with one hash: not hidden, largest, most pixels, best name, shortest path, first path."""
    area = F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0))
    return first_per(files, ["sha256"], [F.col("is_hidden"), F.desc("size_bytes"), area.desc(), score.desc(), F.length("rel_path"), F.lower("rel_path")])


def base_pictures(pictures: DataFrame) -> DataFrame:
    """Of each slide: per medium the uncropped one, then the larger; of these the largest."""
    per_medium = first_per(pictures, ["slide", "media_name"], [F.col("crop_any"), F.desc("area"), F.col("idx")])
    return first_per(per_medium, ["slide"], [F.desc("area"), F.col("idx")])


def first_labels(regions: DataFrame, n: int = 3) -> DataFrame:
    """The first n distinct labels of each image in order of ids, joined."""
    once = regions.where("trim(label) <> ''").groupBy("image_id", "label").agg(F.min("id").alias("id"))
    top = first_per(once, ["image_id"], [F.col("id")], n, rank="k")
    return top.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda s: s["label"]), " / ").alias("labels"))
