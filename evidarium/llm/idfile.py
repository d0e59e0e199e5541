"""Token ids in binary files: ids ranked by frequency, in a byte-aligned code with separate control bytes.

A file is: magic, number of ids, length of the control bytes, control bytes, data bytes. Each id is written as its rank
(0: the most frequent) in the fewest bytes of 1 to 4, low byte first; a control byte holds the lengths less one of four
ids, two bits each, lowest bits first. Reading looks up all control bytes in a table of 256 rows at once. Files follow
one another in ascending order of the documents' ids; the table of ranks lies beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table, with_text
from .files import read_at, write_whole
from .tokens import default_vocabulary, library_words, vocabulary_size

MAGIC = b"EVID0001"
HEAD = 24
#: A file is closed when it has as many ids or documents.
FILE_IDS, FILE_DOCUMENTS = 8_000_000, 100_000
#: Rows of LENGTHS: the byte lengths of the four ids that a control byte speaks for.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = (1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    four = code.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))
    value = raw[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(size > i)
        value[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return value


class IdFiles(NamedTuple):
    #: file (URI), id, place (row in its file), n_ids: one row per document, in the order of the files.
    documents: DataFrame
    #: URI of the ids by rank, 4 bytes each.
    ranks: str


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> IdFiles:
    """Encode every text, end it by end_id, and write all ids to files in ascending order of the documents' ids.

    Null counts as empty and gives end_id alone; documents without an id come first; rows that share an id follow one
    another by the crc32 of their texts, so that files can be parted among them too. Repeated rows are each written. A text
    longer than a file is not cut. An empty table gives no file.
    """
    spark = docs.sparkSession
    size = max(vocabulary_size(vocabulary), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze = library_words(vocabulary, width), zstandard.ZstdCompressor(1)
        end, total = np.array([end_id], width).tobytes(), np.zeros(size, np.int64)
        for batch in batches:
            kind = batch.column("id").type
            blobs = [b + end for b in words.of_column(batch.column("text"))]
            total += np.bincount(np.frombuffer(b"".join(blobs), width), minlength=size)
            small = [squeeze.compress(b) for b in blobs]
            n = [len(b) // np.dtype(width).itemsize for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(small, pa.binary()), pa.nulls(len(n), pa.binary())], names=names)
        if total.any():  # a row for the task: how often it saw each id
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    names = ["id", "tie", "n_ids", "ids", "seen"]
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("tie"), text.alias("text"))
    rows = with_text(rows, "text", ["id", "tie"]).select("record.id", "record.tie", "text")
    schema = rows.select("id", "tie").schema.add("n_ids", "long").add("ids", "binary").add("seen", "binary")
    for field in schema:
        field.nullable = True  # the rows of counts have neither
    whole = materialize(rows.mapInArrow(encode, schema), "ids-encoded", "none")
    stage = whole.where("seen is null").drop("seen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for seen in batch.column("seen").to_pylist():
                total += np.frombuffer(seen, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    # one row per id of the vocabulary at most
    seen = whole.where("seen is not null").select("seen").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").collect()
    order = np.array([r["token"] for r in seen] or [0], np.int64)
    rank = np.zeros(size, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    folder = scratch(spark, "ids-files")
    write_whole(f"{folder}/ranks.bin", [order.astype("<u4").tobytes()])
    shared = spark.sparkContext.broadcast(rank)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, total = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ids_: list = []
        n_ids: list[int] = []

        def close() -> pa.RecordBatch:
            file = f"{folder}/part-{part:08d}-{number:06d}.ids"
            control, data = pack(np.concatenate(held))
            write_whole(file, [MAGIC, sum(n_ids).to_bytes(8, "little"), len(control).to_bytes(8, "little"), control, data])
            return pa.RecordBatch.from_arrays([pa.array([file] * len(ids_)), pa.array(ids_, id_type), pa.array(range(len(ids_)), pa.int64()), pa.array(n_ids, pa.int64())], names=["file", "id", "place", "n_ids"])

        for batch in batches:
            id_type = batch.column("id").type
            for i, n, blob in zip(*(batch.column(c).to_pylist() for c in ("id", "n_ids", "ids"))):
                held.append(shared.value[np.frombuffer(zstandard.decompress(blob), width)])
                ids_.append(i)
                n_ids.append(n)
                total += n
                if total >= FILE_IDS or len(ids_) >= FILE_DOCUMENTS:
                    yield close()
                    held, ids_, n_ids, number, total = [], [], [], number + 1, 0
        if ids_:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "tie", "row"]
    sorted_ = stage.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = stage.select(F.lit("").alias("file"), "id", F.lit(0).cast("long").alias("place"), "n_ids").schema
    return IdFiles(materialize(sorted_.mapInArrow(save, schema), "ids-documents"), f"{folder}/ranks.bin")


def read_ids(files: IdFiles) -> DataFrame:
    """Decode the files: file, place and the document's ids (little-endian unsigned 32-bit). A task reads whole files,
    one at a time; each is cut into documents by the lengths of its documents."""
    documents, ranks = files.documents, files.ranks
    lengths = documents.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "n_ids"))).alias("of"))  # FILE_DOCUMENTS at most

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .files import opened

        order = None
        for batch in batches:
            for file, of in zip(batch.column("file").to_pylist(), batch.column("of")):
                system, path = opened(file)
                if order is None:
                    size = opened(ranks)[0].get_file_info(opened(ranks)[1]).size
                    order = np.frombuffer(read_at(ranks, 0, size), "<u4")
                raw = read_at(file, 0, system.get_file_info(path).size)
                assert raw[:8] == MAGIC
                total, control = (int.from_bytes(raw[i : i + 8], "little") for i in (8, 16))
                ids = order[unpack(raw[HEAD : HEAD + control], raw[HEAD + control :], total)]
                n = np.array(of.values.field("n_ids"), np.int64)
                ends = np.cumsum(n)
                assert ends[-1] == total
                for i in range(0, len(n), 500):
                    cut = [ids[e - k : e].astype("<u4").tobytes() for k, e in zip(n[i : i + 500], ends[i : i + 500])]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(cut)), pa.array(np.arange(i, i + len(cut)), pa.int64()), pa.array(cut, pa.binary())], names=["file", "place", "ids"])

    return lengths.mapInArrow(load, "file string, place long, ids binary")


def starts_of(files: IdFiles) -> DataFrame:
    """documents with start: the ids of all documents before. Sums run within a file; files add one row each."""
    within = Window.partitionBy("file").orderBy("place")
    rows = files.documents.withColumn("before", F.sum("n_ids").over(within) - F.col("n_ids"))
    sizes = files.documents.groupBy("file").agg(F.sum("n_ids").alias("size"))
    base = sizes.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("base"))
    return rows.join(base, "file").withColumn("start", F.col("base") + F.col("before")).drop("before", "base")


def op6_ranked_id_files(spark, sf_dir):
    files = write_ids(table(spark, sf_dir, "documents"), default_vocabulary())
    read = read_ids(files).select("file", "place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return starts_of(files).join(read, ["file", "place"]).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
