"""Numbers within keys, and children in pages of bounded length, without a task for each key.

Rows are sorted by ranges, so that the rows of one key may lie in many partitions. A row's number is its place in its
partition, plus what the partitions before hold of its key: one row for each key that goes on from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def numbered_within(rows: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """rows with their number (from 1) within equal keys, nulls being equal, in the given order; rows alike in all of it are
    numbered in any order. keys may be empty: all rows then are numbered through."""
    spark = rows.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.asc(k) for k in keys], *order, F.asc("_tie")]
    place = F.monotonically_increasing_id()
    dealt = rows.withColumn("_tie", place).repartitionByRange(count, *by).sortWithinPartitions(*by).drop("_tie")
    dealt = kept(dealt.withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sums = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    # Only a partition's first key can go on from the one before, and only its own rows stand before its first place.
    heads = sums.where("_first = 0").select("_part", *keys)
    own = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.join(heads.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).distinct(), [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], "left_semi") if keys else sums
    carry = before.withColumn("_before", F.sum("_n").over(own)).select("_part", *keys, "_first", F.coalesce("_before", F.lit(0).cast("long")).alias("_before"))
    carry = carry.where("_first = 0 and _before > 0").select(F.col("_part").alias("_c_part"), *[F.col(k).alias(f"_c_{k}") for k in keys], "_before")
    starts = sums.select(F.col("_part").alias("_s_part"), *[F.col(k).alias(f"_s_{k}") for k in keys], "_first")
    match = lambda p: [F.col("_part") == F.col(f"{p}_part"), *[F.col(k).eqNullSafe(F.col(f"{p}_{k}")) for k in keys]]
    out = dealt.join(starts, match("_s")).join(F.broadcast(carry), match("_c"), "left")  # one carry a partition at most
    number = F.col("_place") - F.col("_first") + 1 + F.coalesce("_before", F.lit(0).cast("long"))
    return out.select(*rows.columns, number.cast("long").alias(name))


def children_pages(children: DataFrame, key: str, name: str, *columns: str, size: int = 100, newest: bool = False) -> DataFrame:
    """(key, page, name): the children of each key as arrays of structs of the given columns, sorted by them (newest: falling),
    `size` to a page, pages numbered from 0. No row holds more than a page, and no task sorts all of a key. Children without
    a key are left out; keys without children have no pages; repeated children stay."""
    order = [F.desc_nulls_last(c) if newest else F.asc_nulls_first(c) for c in columns]
    numbered = numbered_within(children.where(F.col(key).isNotNull()).select(key, *columns), [key], order, "_number")
    paged = numbered.withColumn("page", F.floor((F.col("_number") - 1) / size).cast("long"))
    page = F.array_sort(F.collect_list(F.struct("_number", F.struct(*columns).alias("row"))))
    return paged.groupBy(key, "page").agg(F.transform(page, lambda r: r["row"]).alias(name))
