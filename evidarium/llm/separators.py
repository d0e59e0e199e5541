"""Token counts of documents from flat files of token ids without an index.

A file is nothing but ids of fixed width, one document after another, each ended by the end-of-document id. Files are cut
into blocks of BLOCK_IDS ids wherever that falls. Each block is searched for the end id by one vectorised comparison;
a prefix scan over the blocks of a file, and one over files, then gives the position, the number and the last end before
each block, by which a document that begins in one block and ends in a later one gets its whole count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table, with_text
from .files import read_at, write_whole
from .tokens import default_vocabulary, library_words

BLOCK_IDS = 4 << 20
#: Files written here are closed at this many ids.
FILE_IDS = 16_000_000


def write_flat(docs: DataFrame, vocabulary: str, end_id: int, width: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode every text and write flat files. Returns their folder and, for each row, id, file and place (its number in
    the file). Strings of special tokens inside a text are ordinary text, so end_id only stands at the end of one. Null
    counts as empty, and both give the end id alone; repeated rows and rows that share an id or have none are written one
    by one; a text longer than a file is not cut; an empty table gives a folder without ids."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "flat-tokens")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = library_words(vocabulary, width, literal_specials=True), np.array([end_id], width).tobytes()
        part, number, held, ids, total = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:08d}-{number:06d}.bin"
            write_whole(f"{folder}/{name}", held)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([name] * len(ids)), pa.array(range(len(ids)), pa.int64())], names=["id", "file", "place"])

        for batch in batches:
            kind = batch.column("id").type
            for i, blob in zip(batch.column("id").to_pylist(), words.of_column(batch.column("text"))):
                held += [blob, end]
                ids.append(i)
                total += len(blob) + len(end)
                if total >= FILE_IDS * len(end):
                    yield close()
                    number, held, ids, total = number + 1, [], [], 0
        if ids:
            yield close()

    write_whole(f"{folder}/none.bin", [])  # so that the folder is there even if no row is
    rows = with_text(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", ["id"]).select("record.id", "text")
    return folder, materialize(rows.mapInArrow(save, rows.select("id").schema.add("file", "string").add("place", "long")), "flat-order")


def count_flat(spark: SparkSession, folder: str, end_id: int, width: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Every document of the folder's *.bin files, taken in order of their names as one stream.

    An empty folder gives no rows. Returns file and place (of the file in which the document ends, and its number among those that end there), number
    (among all), start (ids before it, end ids included), n_tokens (without the end id) and ended. What follows the last
    end id, if anything, is a row with ended false and place null. A file may begin or end in the middle of a document.
    """
    size = np.dtype(width).itemsize

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, start, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(read_at(path, start * size, length * size), width)
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["path", "block", "n", "ends"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", F.floor(F.col("length") / size).cast("long").alias("n")).where("n > 0")
    blocks = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_ids).cast("long"))).alias("block"), "n")
    blocks = blocks.select("path", "block", (F.col("block") * block_ids).alias("start"), F.least(F.lit(block_ids).cast("long"), F.col("n") - F.col("block") * block_ids).alias("length"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(blocks.repartition(parts, "path", "block").mapInArrow(search, "path string, block long, n long, ends array<long>"), "flat-ends")

    # Within a file: ids, ends and the last end's position before each block.
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    b = found.withColumn("at", zero(F.sum("n").over(order))).withColumn("k", zero(F.sum(F.size("ends")).over(order)))
    b = b.withColumn("tail", F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))).withColumn("last", F.max("tail").over(order))
    # From file to file: one row each.
    files = b.groupBy("path").agg(F.sum("n").alias("ids"), F.sum(F.size("ends")).cast("long").alias("m"), F.max("tail").alias("tail"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("file_at", zero(F.sum("ids").over(before))).withColumn("file_k", zero(F.sum("m").over(before)))
    files = files.withColumn("file_last", F.max(F.col("file_at") + F.col("tail")).over(before))
    s = b.join(files.select("path", "file_at", "file_k", "file_last"), "path")
    s = s.withColumn("open", F.coalesce(F.col("file_at") + F.col("last"), "file_last", F.lit(-1).cast("long")) + 1)  # where the block's first document began
    first = lambda end, i: F.when(i > 0, F.col("base") + F.get("ends", i - 1) + 1).otherwise(F.col("open"))
    spans = F.transform("ends", lambda end, i: F.struct(first(end, i).alias("start"), (F.col("base") + end).alias("end")))
    e = s.withColumn("base", F.col("file_at") + F.col("at")).select("path", "k", "file_k", F.posexplode(spans).alias("i", "span"))
    name = F.element_at(F.split("path", "/"), -1)
    whole = e.select(name.alias("file"), (F.col("k") + F.col("i")).alias("place"), (F.col("file_k") + F.col("k") + F.col("i")).alias("number"), "span.start", (F.col("span.end") - F.col("span.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    total = files.agg(F.max("path").alias("path"), F.sum("ids").alias("ids"), F.sum("m").alias("m"), (F.max(F.col("file_at") + F.col("tail")) + 1).alias("from"))
    start = F.coalesce("from", F.lit(0).cast("long"))
    rest = total.select(name.alias("file"), F.lit(None).cast("long").alias("place"), F.col("m").alias("number"), start.alias("start"), (F.col("ids") - start).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return whole.unionByName(rest)


def op2_token_counts(spark, sf_dir):
    vocabulary, end_id = default_vocabulary(), 49407
    folder, order = write_flat(table(spark, sf_dir, "documents"), vocabulary, end_id)
    counts = count_flat(spark, folder, end_id)
    return order.join(counts, ["file", "place"]).select(F.col("id").alias("doc_id"), "start", "n_tokens")
