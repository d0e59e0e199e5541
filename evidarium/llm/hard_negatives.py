"""Hard-negative mining with exact integer scores from Kronecker-packed products.

The components of several candidates are biased to be non-negative and laid side by side as fields of one wide integer, one
such integer for each dimension. Multiplying it by an anchor's biased component gives that dimension's products of all these
candidates at once; summed over the dimensions, each field holds one candidate's biased score, as it is wide enough for the
largest sum that can occur in the block. The fields are unpacked and the biases taken off, so scores are exact.

Rows stay in their partitions and are taken in blocks. Anchors are a table in the shared folder, which each task streams in
batches: neither side is broadcast or replicated. Every block gives an anchor at most as many rows as are wanted of it, and
Spark keeps the first of them by partial ranks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .files import opened

#: Candidates of a block, and anchors that meet it at a time, at most; blocks of long vectors have fewer.
BLOCK_ROWS, BATCH_ANCHORS = 8192, 512
BLOCK_VALUES = 2 << 20
#: Bits of the wide integer: a machine word, or as many as eight fields need where one field is longer than a word.
WORD, WIDE_FIELDS = 64, 8
#: Products of components that one task is meant to make.
TASK_PRODUCTS = 4_000_000_000
#: Scores beyond the range of a long are written as its ends, and ranked so.
LEAST, MOST = -(2**63), 2**63 - 1


def whole_components(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of doubles: int64, or Python integers where that is too narrow."""
    x = np.floor(scale * values)
    if x.size == 0 or np.abs(x).max() < 2**31:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def rectangle(vectors: pa.Array, scale: float, width: int = 0) -> np.ndarray:
    """Vectors as rows of whole components; the shorter ones end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    flat = whole_components(np.asarray(vectors.flatten(), np.float64), scale)
    width = max([width, *sizes.tolist()])
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Packed:
    """A block of candidates, as many as fit side by side in each wide integer."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.least = rows, rows.min(axis=0, initial=0)
        self.biased = (rows - self.least).T  # dimensions x candidates
        self.most = self.biased.max(axis=1, initial=0)
        self.words: dict[int, tuple[np.ndarray, int]] = {}

    def packed(self, bits: int) -> tuple[np.ndarray, int]:
        """Wide integers by dimension and group of candidates, for fields of so many bits, and their fields."""
        if bits not in self.words:
            narrow = bits <= WORD
            kind, fields = (np.uint64, WORD // bits) if narrow else (object, WIDE_FIELDS)
            dims, n = self.biased.shape
            groups = -(-n // fields)
            cells = np.zeros((dims, groups * fields), kind)
            cells[:, :n] = self.biased
            words = np.zeros((dims, groups), kind)
            for f in range(fields):  # field f of group g is candidate f * groups + g
                part = cells[:, f * groups : (f + 1) * groups]
                words |= part << (np.uint64(bits * f) if narrow else bits * f)
            self.words = {bits: (words, fields)}
        return self.words[bits]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, anchors x candidates, as int64."""
        (m, dims), n = anchors.shape, len(self.rows)
        if not (m and dims and n):
            return np.zeros((m, n), np.int64)
        least = anchors.min(axis=0)
        biased = anchors - least
        bound = max(int(x) for x in biased.astype(object) @ self.most.astype(object))
        bits = max(bound.bit_length(), 1)
        words, fields = self.packed(bits)
        narrow = bits <= WORD
        factors = biased.astype(np.uint64 if narrow else object)
        summed = np.zeros((m, words.shape[1]), words.dtype)
        for i in range(0, m, 64):
            own, out = factors[i : i + 64], summed[i : i + 64]
            for j in range(dims):
                out += own[:, j, None] * words[j]
        mask, pieces = (np.uint64((1 << bits) - 1) if narrow else (1 << bits) - 1), []
        for f in range(fields):
            pieces.append((summed >> (np.uint64(bits * f) if narrow else bits * f)) & mask)
        unpacked = np.concatenate(pieces, axis=1)[:, :n]
        by_row, by_anchor = self.rows.astype(object) @ least.astype(object), biased.astype(object) @ self.least.astype(object)
        reach = max(abs(int(x)) for x in (*by_row, *by_anchor, bound))
        if narrow and reach < 2**61:
            return unpacked.astype(np.int64) + by_row.astype(np.int64) + by_anchor.astype(np.int64)[:, None]
        whole = unpacked.astype(object) + by_row + by_anchor[:, None]
        return np.clip(whole, LEAST, MOST).astype(np.int64)


def first_of(scores: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and candidates (by number) of the first allowed ones of each anchor: higher scores, then smaller numbers."""
    n = scores.shape[1]
    if n > count:
        floor = np.partition(np.where(allowed, scores, LEAST), n - count, axis=1)[:, n - count]
        allowed = allowed & (scores >= floor[:, None])
    a, c = np.nonzero(allowed)
    order = np.lexsort((c, -scores[a, c].astype(object) if len(a) and scores.min() == LEAST else -scores[a, c], a))
    a, c = a[order], c[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < count], c[place < count]


def batches_of(uri: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet table in the shared folder, a batch at a time."""
    system, path = opened(uri)
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=size)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until a block is full."""
    held, rows, values = [], 0, 0
    for batch in batches:
        at = 0
        while at < len(batch):
            sizes = batch.column("vector").value_lengths().to_numpy()[at:]
            take = max(1, min(BLOCK_ROWS - rows, int(np.searchsorted(np.cumsum(sizes), BLOCK_VALUES - values, "right"))))
            held.append(batch.slice(at, take))
            at, rows, values = at + take, rows + take, values + int(sizes[:take].sum())
            if rows >= BLOCK_ROWS or values >= BLOCK_VALUES:
                yield pa.Table.from_batches(held)
                held, rows, values = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def in_id_order(block: pa.Table) -> pa.Table:
    """Smaller ids first, rows without an id last, rows that share one by their number."""
    return block.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()


def column(block: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    out = block.column(name)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def best_positives(scale: float, count: int, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in map(in_id_order, blocks_of(batches)):
            row, label = (column(block, x).to_numpy() for x in ("row", "label"))
            packed = Packed(rectangle(column(block, "vector"), scale))
            for anchors in batches_of(uri, BATCH_ANCHORS):
                own, labels = column(anchors, "row").to_numpy(), column(anchors, "label").to_numpy()
                scores = packed.scores(fitted(rectangle(column(anchors, "vector"), scale), packed))
                a, c = first_of(scores, (labels[:, None] == label) & (own[:, None] != row), count)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(row[c]), column(block, "id").take(pa.array(c)), pa.array(scores[a, c])], names=["anchor_row", "row", "id", "score"])

    return run


def fitted(anchors: np.ndarray, packed: Packed) -> np.ndarray:
    """Anchors cut or lengthened by zeros to the block's dimensions: what a vector lacks counts as zero."""
    dims = packed.rows.shape[1]
    if anchors.shape[1] >= dims:
        return anchors[:, :dims]
    return np.pad(anchors, ((0, 0), (0, dims - anchors.shape[1])))


def best_negatives(scale: float, count: int, low: int, high: int, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in map(in_id_order, blocks_of(batches)):
            row, label = (column(block, x).to_numpy() for x in ("row", "label"))
            packed = Packed(rectangle(column(block, "vector"), scale))
            for anchors in batches_of(uri, BATCH_ANCHORS):
                own, labels = column(anchors, "row").to_numpy(), column(anchors, "label").to_numpy()
                scores = packed.scores(fitted(rectangle(column(anchors, "vector"), scale), packed))
                other = labels[:, None] != label
                given = column(anchors, "positives")
                marks = given.flatten().to_numpy()
                places = np.arange(len(marks)) - np.repeat(given.offsets.to_numpy()[:-1] - given.offsets[0].as_py(), given.value_lengths().to_numpy())
                owner = np.repeat(np.arange(len(own)), given.value_lengths().to_numpy())
                for k in range(int(places.max(initial=-1)) + 1):
                    who, mark = owner[places == k], marks[places == k]
                    # low * mark <= 100 * score <= high * mark, in whole numbers
                    least = np.array([max(-(-low * int(x) // 100), LEAST) if low * int(x) <= 100 * MOST else MOST for x in mark], np.int64)
                    most = np.array([min(high * int(x) // 100, MOST) if high * int(x) >= 100 * LEAST else LEAST for x in mark], np.int64)
                    s = scores[who]
                    a, c = first_of(s, other[who] & (s >= least[:, None]) & (s <= most[:, None]), count)
                    places_of = pa.array(np.full(len(a), k, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(own[who][a]), places_of, pa.array(row[c]), column(block, "id").take(pa.array(c)), pa.array(s[a, c])], names=["anchor_row", "place", "row", "id", "score"])

    return run


def ranked(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its first positives the first negatives whose score lies between low and high per cent of
    the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * component), exact. Positives have the anchor's label and are other rows than
    it, negatives another label; higher scores come first, then smaller ids, rows without an id last. Rows with a null
    label, a null vector or a component that is null or not finite take no part; a component that a shorter vector lacks
    counts as zero. Labels are integers. Repeated rows are rows of their own, also as anchors; a null id makes no anchor
    by itself (is_anchor says so). Anchors without positives or without such negatives have no rows, nor has an empty table.
    Every anchor meets every row: the work is the product of both, dealt to tasks by it.
    """
    spark = rows.sparkSession
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(scale)) == float("inf"))
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    some = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    some = some.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", odd))
    some = materialize(some.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    work = some.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("m"), F.max(F.size("vector")).alias("dims")).first()
    products = work["n"] * (work["m"] or 0) * max(work["dims"] or 0, 1)
    tasks = max(spark.sparkContext.defaultParallelism, -(-products // TASK_PRODUCTS))
    dealt = some.select("row", "id", "label", "vector").repartition(tasks)
    anchors = some.where("anchor").select("row", "id", "label", "vector")

    def stored(df: DataFrame, name: str) -> str:
        path = scratch(spark, name)
        df.write.parquet(path)
        return path

    found = dealt.mapInArrow(best_positives(scale, positives, stored(anchors, "negatives-anchors")), "anchor_row long, row long, id long, score long")
    first = ranked(found, ["anchor_row"], positives).select("anchor_row", F.struct("rank", "id", "score").alias("positive"))
    lists = first.groupBy("anchor_row").agg(F.sort_array(F.collect_list("positive")).alias("list"))  # `positives` at most each
    paired = materialize(anchors.withColumnRenamed("row", "anchor_row").join(lists, "anchor_row"), "negatives-positives")
    uri = stored(paired.select(F.col("anchor_row").alias("row"), "label", "vector", F.col("list.score").alias("positives")), "negatives-marks")
    near = dealt.mapInArrow(best_negatives(scale, negatives, low, high, uri), "anchor_row long, place int, row long, id long, score long")
    best = ranked(near, ["anchor_row", "place"], negatives)
    positive = paired.select("anchor_row", F.col("id").alias("anchor_id"), F.posexplode("list").alias("place", "positive"))
    out = best.join(positive, ["anchor_row", "place"])
    return out.select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, id, score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
