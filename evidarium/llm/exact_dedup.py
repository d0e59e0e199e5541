"""Exact deduplication by stateful streaming.

The rows are written to an intake table, which a structured stream reads. The stream keeps one entry per digest in a
RocksDB state store, without expiry: the digest, the smallest identifier so far, where that row's content lies in the
intake table, and how many rows had the digest. A row that hits an entry is then compared with the entry's content
byte for byte, so that two texts with one digest stay apart.

Only rows with a digest that several have are ever shuffled with their contents: a bitmap of such digests, of bounded
size, tells the others apart where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, one_blank, packed, scratch

#: Disk-backed state; a batch writes only its changes, no store reserves files ahead, as there may be many small ones, and
#: all stores of an executor share a bounded memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


#: Micro-batches of a run, about, so that rows hit what earlier batches have left in the state.
BATCHES = 4
#: Bits of the bitmap for each digest in it, and in all; with more digests than that it only lets more rows through.
BITS, MOST_BITS = 64, 1 << 28
BITMAP = 1 << 15  # bits of one row of Spark's bitmap functions


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def registry_of(intake: DataFrame, path: str, files_per_batch: int) -> DataFrame:
    """One row per digest of the intake table at path: first (the row that stays and its locator) and n (rows)."""
    spark, out = intake.sparkSession, scratch(intake.sparkSession, "dedup-registry")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a replayed batch replaces itself

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(intake.schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(path)
        first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_id")
        entries = stream.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
        query = entries.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "dedup-state")).foreachBatch(save).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(entries.schema.add("batch", "long")).parquet(out)
    return found.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("entry")).select("digest", "entry.first", "entry.n")


def parted(intake: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The intake's rows that may have a digest of several, all that do among them, and the others. The bitmap's rows, of
    4 KB, are MOST_BITS / BITMAP at most, so they are broadcast."""
    wanted = several.count()
    bits = min(max(BITMAP, 1 << (BITS * wanted - 1).bit_length() if wanted else 0), MOST_BITS)
    slot = F.xxhash64("digest").bitwiseAND(F.lit(bits - 1)) + 1
    held = several.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    held = materialize(held.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "dedup-bitmap")
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substr("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = intake.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(held), "bucket", "left")
    there = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.where(there).select(*intake.columns), rows.where(~there).select(*intake.columns)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex, files_per_batch: int | None = None) -> DataFrame:
    """Which rows of docs hold a text that another row holds already.

    Texts are equal when they are identical once each run of ASCII white space is one space; null counts as empty. Of
    equal texts the row with the smallest id stays, rows without an id come last, and of rows that share the id one
    stays. Returns a row for each row of docs: record (its columns, whatever their names), keep_id (id of the row that
    stays), group_size, kept, content_sha256. An empty table gives no rows.

    digest may be any function of the normalised text: its collisions are resolved by the comparison of contents.
    """
    text = one_blank(F.col(f"`{text_col}`"))
    rows = packed(docs, id=F.col(f"`{id_col}`"), row_id=F.monotonically_increasing_id(), digest=digest(text))
    if not rows.take(1):
        return rows.select("record", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("content_sha256"))
    path = scratch(docs.sparkSession, "dedup-intake")
    rows.write.option("compression", "zstd").parquet(path)
    intake = docs.sparkSession.read.schema(rows.schema).parquet(path)
    files = files_per_batch or max(1, -(-len(intake.inputFiles()) // BATCHES))
    registry = materialize(registry_of(intake, path, files), "dedup-registry")

    content = one_blank(F.col(f"record.`{text_col}`"))
    sha = F.col("digest") if digest is sha256_hex else F.sha2(content, 256)
    several = registry.where("n > 1").select("digest", F.col("first.row_id").alias("at"))
    common, single = parted(intake, several)
    hits = materialize(common.select("row_id", "digest", content.alias("content")).join(several, "digest"), "dedup-hits")
    held = hits.where("row_id = at").select("digest", F.col("content").alias("held"))
    odd = materialize(hits.where("row_id <> at").join(held, "digest").where("content <> held").select("row_id", "digest", "content"), "dedup-collisions")

    entries = registry.select("digest", "first", "n")
    if odd.take(1):  # a digest of several texts: its rows get an entry for each text
        texts = odd.join(common.select("row_id", "id"), "row_id").groupBy("digest", "content").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        texts = materialize(texts, "dedup-entries")
        less = texts.groupBy("digest").agg(F.sum("n").alias("odd"))
        entries = entries.join(less, "digest", "left").select("digest", F.lit(None).cast("long").alias("other"), "first", (F.col("n") - F.coalesce("odd", F.lit(0))).alias("n"))
        entries = entries.union(texts.select("digest", F.col("first.row_id"), "first", "n"))
        others = odd.join(texts, ["digest", "content"]).select("row_id", F.col("first.row_id").alias("other"))
        joined = common.join(others, "row_id", "left").alias("k").join(entries.alias("e"), (F.col("k.digest") == F.col("e.digest")) & F.col("k.other").eqNullSafe(F.col("e.other")))
        keyed = joined.select("k.record", "k.row_id", "k.digest", "e.first", "e.n")
    else:
        keyed = common.join(entries, "digest")
    out = keyed.select("record", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row_id") == F.col("first.row_id")).alias("kept"), sha.alias("content_sha256"))
    return out.union(single.select("record", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("content_sha256")))


def op1_exact_dedup(spark, sf_dir):
    from .common import table

    found = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("record.doc_id", "keep_id", "group_size", "kept", F.col("content_sha256").alias("text_sha256"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
"""
