"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in order of their id. A keyed Feistel network on the pairs (l, r) of a a x b grid with
n <= a * b < n + a permutes the grid; a number that lands at n or beyond walks on along its cycle until it is below n.
The new number p gives shard p mod k and slot p div k, so both can be computed from a row number, n, k and the seed.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 6


def feistel(x: Column, a: Column, b: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over x = l * b + r. Rounds change l and r in turn by the digest of the other."""

    def mixed(half: Column, i: int, modulus: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), half.cast("string")))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % modulus

    def step(i: int):
        if i % 2 == 0:
            return lambda s: F.struct(((s["l"] + mixed(s["r"], i, a)) % a).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], i, b)) % b).alias("r"))

    state = F.array(F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r")))
    for i in range(rounds):
        state = F.transform(state, step(i))
    done = F.element_at(state, 1)
    return done["l"] * b + done["r"]


def permuted(x: Column, n: Column, seed: int) -> Column:
    """The place of row number x among n under the permutation. A cycle has at most a * b - n numbers at n or beyond,
    so as many steps always suffice; they are taken only by rows that the first step leaves outside."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    b = F.greatest(F.ceil(n / a).cast("long"), F.lit(1))
    once = feistel(x, a, b, seed)
    walk = lambda y: F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - n), y, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, a, b, seed)))
    return F.element_at(F.transform(F.array(once), lambda y: F.when(y < n, y).otherwise(walk(y))), 1)


def place_of(x: int, n: int, shards: int, seed: int = 0, rounds: int = ROUNDS) -> tuple[int, int]:
    """(shard, slot) of row number x, without Spark: what a reader computes to find a row."""
    a = max(math.isqrt(n - 1) + 1, 1) if n > 0 else 1
    b = max(-(-n // a), 1)
    while True:
        l, r = divmod(x, b)
        for i in range(rounds):
            half, modulus = (r, a) if i % 2 == 0 else (l, b)
            mix = int(hashlib.md5(f"{seed}:{i}:{half}".encode()).hexdigest()[:12], 16) % modulus
            l, r = ((l + mix) % a, r) if i % 2 == 0 else (l, (r + mix) % b)
        x = l * b + r
        if x < n:
            return x % shards, x // shards


def numbered(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """rows with row_number (0..n-1 in the given order) and n. Rows are range-partitioned and sorted, written once, and
    get their partition's start plus their place in it: no step sees all rows. The starts are one row per partition."""
    spark = rows.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = [*order, "tie"]  # rows alike in all of order can be parted too
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(count, *tied).sortWithinPartitions(*tied).drop("tie")
    place = F.monotonically_increasing_id()
    dealt = materialize(dealt.withColumns({"part_no": F.shiftright(place, 33), "part_row": place.bitwiseAND(F.lit((1 << 33) - 1))}), "shard-numbers")
    sizes = dealt.groupBy("part_no").agg(F.count(F.lit(1)).alias("size"))
    by_part = Window.orderBy("part_no")  # over one row per partition
    starts = sizes.select("part_no", (F.sum("size").over(by_part) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy()).alias("n"))
    return dealt.join(F.broadcast(starts), "part_no").withColumn("row_number", F.col("start") + F.col("part_row")).drop("part_no", "part_row", "start")


def shard(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal the rows of docs to shards of sizes at most one apart (law `rows`), in shuffled order.

    Returns id, size (UTF-8 bytes of the text plus 16; null has none), text_crc32, law, shard, slot (0.. in each shard),
    grown_shard (null under this law) and row_number. Rows are numbered by id, nulls first; rows that share an id go by
    crc and size, so repeated rows get places of their own. An empty table gives no rows.
    """
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    dealt = numbered(rows, ["id", "text_crc32", "size"]).withColumn("place", permuted(F.col("row_number"), F.col("n"), seed))
    place = F.col("place")
    return dealt.select("id", "size", "text_crc32", F.lit("rows").alias("law"), (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_feistel_shards(spark, sf_dir):
    from .common import table

    return shard(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
