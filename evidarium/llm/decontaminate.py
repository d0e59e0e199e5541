"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words; an item with fewer is one window. A window is a set of
shingles of up to three words with their places in it. A document holds the window if some stretch of its words, of the
window's length, has all of them: containment of 1, for which one prefix shingle suffices, so each window is joined by its
rarest shingle alone, rarity being the count over all documents. The shingle's place in the window gives the only
possible stretch; it must lie inside the document, and then its words are compared with the window's.

The documents are read twice, whatever the size of the benchmark: once to count shingles, once for the places where a
prefix shingle may begin. Sieves of bounded size, built by Spark, tell which shingles matter at all. Windows, counts,
prefixes and places are tables, joined by Spark; none of them goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, texts_in, with_text
from .jaccard import FACTORS, word_hashes
from .tokens import texts_of

WINDOW, SHINGLE = 10, 3
#: Bits of a sieve for each shingle in it, and bits of one at most. More shingles than that leave it less sharp, no more.
SIEVE_BITS, MOST_BITS = 64, 1 << 28
BITMAP = 1 << 15  # bits of a bitmap of Spark's functions
GROUP_BYTES = 4 << 20
#: Rows of a task's partial counts that are summed up at a time.
COUNTED = 1 << 21

#: Lower-cases A-Z and turns every other byte that is no word character into a space.
WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def shingles_at(w: np.ndarray, width: int) -> np.ndarray:
    """The hash of the shingle that begins at each word; widths keep apart."""
    n = max(len(w) - width + 1, 0)
    h = np.repeat(FACTORS[-1:] * np.uint64(width), n)
    for i in range(width):
        h += w[i : n + i] * FACTORS[i]
    return h.view(np.int64)


class Sieve(NamedTuple):
    """Two bitmaps by different bits of a hash: a shingle whose bit is missing in either is not among these."""

    widths: list[int]
    bits: int
    low: np.ndarray
    high: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        at, other = h & (self.bits - 1), h >> 32 & (self.bits - 1)
        return (self.low[at >> 3] >> (at & 7).astype(np.uint8) & self.high[other >> 3] >> (other & 7).astype(np.uint8) & 1).astype(bool)

    def found(self, docs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """document, place and hash of the shingles of documents that may be among these, by width."""
        size = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(size)
        w = word_hashes(list(chain.from_iterable(docs)))
        for width in self.widths:
            h = shingles_at(w, width)
            at = np.flatnonzero(self.has(h))
            doc = np.searchsorted(ends, at, "right")
            inside = at + width <= ends[doc]
            doc, at = doc[inside], at[inside]
            yield doc, at - (ends - size)[doc], h[at]


def sieve_of(shingles: DataFrame) -> Sieve:
    """shingles: h and width. What goes to the driver is its bitmaps."""
    total = shingles.count()
    bits = min(max(BITMAP, 1 << (SIEVE_BITS * total - 1).bit_length() if total else 0), MOST_BITS)
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    sides = []
    for slot in (F.col("h"), F.shiftright("h", 32)):
        number = slot.bitwiseAND(F.lit(bits - 1)) + 1
        rows = shingles.select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
        side = np.zeros(bits // 8, np.uint8)
        for r in rows:
            side[(r["bucket"] - 1) * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
        sides.append(side)
    return Sieve(widths, bits, *sides)


def groups(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of texts, some MB at a time."""
    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(text)
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def windows_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, window) of the benchmark, each once; a window is its words with a space between."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record = batch.column("record").field(0)
            for i, text in enumerate(texts_in(batch, text_col)):
                w = words_of(text)
                each = list({b" ".join(w[k : k + WINDOW]) for k in range(max(1, len(w) - WINDOW + 1))}) if w else []
                for k in range(0, len(each), 10_000):
                    part = each[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([record.take(pa.array([i] * len(part))), pa.array(part, pa.binary()).cast(pa.string())], names=["item", "window"])

    rows = with_text(benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")), "text", ["item"])
    return materialize(rows.mapInArrow(cut, rows.select("record.item").schema.add("window", "string")).distinct(), "leak-windows")


def shingles_of(windows: DataFrame) -> DataFrame:
    """(window, size, place, h, width): the shingles of each window with their places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for window in batch.column("window").to_pylist():
                w = word_hashes(window.encode().split())
                width = min(SHINGLE, len(w))
                for place, h in enumerate(shingles_at(w, width).tolist()):
                    for column, value in zip(out, (window, len(w), place, h, width)):
                        column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["window", "size", "place", "h", "width"])

    return materialize(windows.select("window").distinct().mapInArrow(cut, "window string, size int, place int, h long, width int"), "leak-shingles")


def counted(docs: DataFrame, text_col: str, sieve: Sieve) -> DataFrame:
    """(slot, n): how often the shingles of a slot occur in all documents. A shingle's count is that of its slot, which is
    never too low and nearly always its own; every order of shingles serves as long as all windows use the same."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, slots, n, held = shared.value, [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            slot, place = np.unique(np.concatenate(slots), return_inverse=True)
            return slot, np.bincount(place.reshape(-1), np.concatenate(n)).astype(np.int64)

        for batch in batches:
            for words in groups(texts_of(batch.column("text"))):
                for _, _, h in sieve.found(words):
                    slot, times = np.unique(h & (sieve.bits - 1), return_counts=True)
                    slots.append(slot)
                    n.append(times)
                    held += len(slot)
                if held > COUNTED:
                    (slot, times), held = summed(), 0
                    slots, n = [slot], [times]
        if slots:
            slot, times = summed()
            for i in range(0, len(slot), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(slot[i : i + 100_000]), pa.array(times[i : i + 100_000])], names=["slot", "n"])

    rows = with_text(docs.select(F.col(f"`{text_col}`").alias("text")), "text", []).select("text")
    return rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


PLACES = "array<struct<place:int,h:long,begin:int,around:string>>"


def places_in(docs: DataFrame, text_col: str, carry: list[str], sieve: Sieve) -> DataFrame:
    """record, n_words and, for each place where a prefix shingle may begin, its hash and the words around it that a window
    could reach; begin is the number of the first of these."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    rows = with_text(docs, text_col, carry)
    kind = pa.list_(pa.struct([("place", pa.int32()), ("h", pa.int64()), ("begin", pa.int32()), ("around", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            found: list[list[dict]] = []
            for docs_ in groups(texts_in(batch, text_col)):
                first = len(found)
                counts += map(len, docs_)
                found += [[] for _ in docs_]
                for doc, place, h in shared.value.found(docs_):
                    for d, p, x in zip(doc.tolist(), place.tolist(), h.tolist()):
                        begin = max(0, p - WINDOW + 1)
                        found[first + d].append({"place": p, "h": x, "begin": begin, "around": b" ".join(docs_[d][begin : p + WINDOW]).decode()})
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["record", "n_words", "places"])

    schema = rows.select("record", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(PLACES).alias("places")).schema
    return rows.mapInArrow(look, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Which words of each document lie inside an occurrence of a benchmark window.

    Words are runs of 0-9, a-z and characters beyond ASCII once A-Z are lower-cased. Returns for each row of docs: record
    (its columns, or those of carry), n_words, runs (array of [first, last + 1] word numbers, merged, ascending) and items
    (distinct ids of the items with a window that occurs; an item without an id is null there). Null and empty texts have
    no words; items without words have no window; items that share an id count as one; repeated rows each count. An empty
    table of documents gives no rows, one of items no runs. Only documents with a place to look at are shuffled.
    """
    windows = windows_of(benchmark, item_col, item_text_col)
    shingles = shingles_of(windows)
    sieve = sieve_of(shingles.select("h", "width").distinct())
    counts = counted(docs, text_col, sieve)
    rated = shingles.withColumn("slot", F.col("h").bitwiseAND(F.lit(sieve.bits - 1))).join(counts, "slot", "left")
    rarest = F.min_by(F.struct("h", "place", "width"), F.struct(F.coalesce("n", F.lit(0).cast("long")), "h", "place"))
    prefixes = rated.groupBy("window", "size").agg(rarest.alias("p")).select("window", "size", "p.h", F.col("p.place").alias("offset"), "p.width")
    prefixes = materialize(prefixes, "leak-prefixes")

    columns = docs.columns if carry is None else carry
    seen = places_in(docs, text_col, columns, sieve_of(prefixes.select("h", "width").distinct()))
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "leak-places")
    spots = seen.where(F.size("places") > 0).select("row", F.explode("places").alias("s")).select("row", "s.*")
    start = F.col("place") - F.col("offset")
    stretch = F.array_join(F.slice(F.split("around", " "), start - F.col("begin") + 1, F.col("size")), " ")
    hits = spots.join(prefixes, "h").where(F.when(start >= 0, stretch == F.col("window")).otherwise(F.lit(False)))
    hits = materialize(hits.select("row", start.alias("first"), (start + F.col("size")).alias("last"), "window").distinct(), "leak-hits")

    items = hits.select("row", "window").distinct().join(windows, "window").select("row", F.struct("item").alias("i")).groupBy("row").agg(F.collect_set("i").alias("i"))
    before = Window.partitionBy("row").orderBy("first", "last")
    apart = hits.select("row", "first", "last").distinct().withColumn("reach", F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    runs = apart.withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("first") > F.col("reach"))).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "run").agg(F.array(F.min("first").cast("long"), F.max("last").cast("long")).alias("r")).groupBy("row").agg(F.array_sort(F.collect_list("r")).alias("r"))
    kind = benchmark.schema[item_col].dataType.simpleString()
    none = (F.array().cast("array<array<long>>"), F.array().cast(f"array<{kind}>"))
    clean = seen.where(F.size("places") == 0).select("record", "n_words", none[0].alias("runs"), none[1].alias("items"))
    other = seen.where(F.size("places") > 0).select("record", "n_words", "row").join(runs.join(items, "row"), "row", "left")
    other = other.select("record", "n_words", F.coalesce("r", none[0]).alias("runs"), F.coalesce(F.transform("i", lambda x: x["item"]), none[1]).alias("items"))
    return clean.union(other)


def n_hit():
    return F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])


def op4_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    names = F.array_sort(F.transform("items", lambda i: F.coalesce(i.cast("string"), F.lit(""))))
    return found.select("record.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
stretches AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT DISTINCT r, i, n, item_id FROM stretches JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
