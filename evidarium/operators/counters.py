"""Several counters in one pass over the rows, as (section, key, count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(df: DataFrame, sections: dict[str, Column], top: int | None = None) -> DataFrame:
    """Counts by each section's expression; null is counted as ''. With top, the most common of each section. One pass by
    grouping sets: a row is expanded to its keys, one set for each section, and summed before the shuffle."""
    keys = [f"_key{i}" for i in range(len(sections))]
    keyed = df.select(*[F.coalesce(e.cast("string"), F.lit("")).alias(k) for k, e in zip(keys, sections.values())])
    sets = keyed.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_set"))
    # In the id of a set, the bit of its own key alone is 0; the first key has the highest bit.
    whole = (1 << len(keys)) - 1
    parts = [(F.col("_set") == whole - (1 << (len(keys) - 1 - i)), F.lit(n), F.col(k)) for i, (n, k) in enumerate(zip(sections, keys))]
    pick = lambda j: F.coalesce(*[F.when(p[0], p[j]) for p in parts])
    out = sets.select(pick(1).alias("section"), pick(2).alias("key"), "count")
    if top is None:
        return out
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("count"), F.asc("key")))
    return out.withColumn("place", place).where(F.col("place") <= top).drop("place")


def duplicate_totals(files: DataFrame, digest: str = "sha256") -> DataFrame:
    """One row: files, unique contents, duplicate files, groups of more than one."""
    groups = files.groupBy(digest).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count(F.lit(1)).alias("unique_files"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("n") > 1).alias("groups"))


def report(**parts: DataFrame) -> DataFrame:
    """Counters (section, key, count) of several tables as one table of (part, section, key, count), in order of parts, then
    sections, then falling counts."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        own = df.select(F.lit(i).alias("_i"), F.lit(name).alias("part"), "section", "key", F.col("count").cast("long").alias("count"))
        out = own if out is None else out.unionByName(own)
    return out.orderBy("_i", "section", F.desc("count"), "key").drop("_i")
