"""Periodic runs of words: stretches in which the same words recur at a fixed distance.

Squares come from a suffix automaton with link-cut access (see suffix_automaton.py) and are extended to runs. What is fed
to it are not single words: a run of four periods holds each of its word triples three times, so only stretches of such
triples are looked at, and triples of a stretch that always follow each other are appended as one symbol. Neither loses
anything: a stretch ends where no run can go on, and such a chain of triples is in a run as a whole or not at all, but at
the end of a stretch, where runs are extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, table, with_text
from .suffix_automaton import repetitions

#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Triples that start in a run of LEAST_WORDS words.
LEAST_TRIPLES = LEAST_WORDS - 2
#: How often each triple occurs in a run of LEAST_PERIODS periods.
LEAST_OFTEN = LEAST_PERIODS - 1


def stretches(words: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may be in a run, and the stretch of each; piece parts the words, and runs are in one piece."""
    at = np.arange(len(words))
    while len(at) > 2:
        w, inside = words[at], piece[:-2] == piece[2:]
        mix = np.uint64(0x9E3779B97F4A7C15)
        key = w.astype(np.uint64)
        for other in (w[1:], w[2:], piece):  # unlike triples with the same key are looked at in vain
            key = (key[: len(other)] * mix) ^ (other[: len(key)].astype(np.uint64) + (key[: len(other)] >> np.uint64(29)))
        key = key[: len(inside)]
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        often = np.empty(len(key), bool)
        often[order] = np.repeat(np.diff(np.append(heads, len(key))), np.diff(np.append(heads, len(key)))) >= LEAST_OFTEN
        often &= inside
        joined = often[1:] & often[:-1] & (piece[1:-2] == piece[:-3])
        begin = np.flatnonzero(often & ~np.append(False, joined))
        end = np.flatnonzero(often & ~np.append(joined, False)) + 3  # of the last triple's words
        long = end - begin >= LEAST_WORDS
        begin, size = begin[long], (end - begin)[long]
        number = np.repeat(np.arange(len(begin)), size)
        kept = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        shrunk = len(kept) < 0.9 * len(at)
        at, piece = at[kept], number
        if not shrunk:
            return at, piece
    return at[:0], piece[:0]


def alike(*columns: np.ndarray) -> np.ndarray:
    """Numbers that are equal where all columns are."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = np.unique(out * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1].astype(np.int64)
    return out


def always_same(symbols: np.ndarray, others: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each place whether its symbol has the same neighbour wherever it has one."""
    least = np.full(int(symbols.max(initial=0)) + 1, np.iinfo(np.int64).max)
    most = np.full(len(least), -1)
    np.minimum.at(least, symbols[there], others[there])
    np.maximum.at(most, symbols[there], others[there])
    return (least == most)[symbols]


def runs_of(words: np.ndarray, piece: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many words and periods, by start and period. words are numbers,
    piece (not decreasing) parts them."""
    if least_words < LEAST_WORDS or least_periods < LEAST_PERIODS:
        raise ValueError(f"runs of fewer than {LEAST_WORDS} words or {LEAST_PERIODS} periods are not looked for")
    at, stretch = stretches(words, piece)
    if not len(at):
        return []
    w = words[at]
    inside = np.append(stretch[:-2] == stretch[2:], [False, False])
    place = np.flatnonzero(inside)  # of the first words of triples
    triple = alike(stretch[place], w[place], w[place + 1], w[place + 2])
    own = stretch[place]
    follows = own[1:] == own[:-1]
    ahead = always_same(triple[:-1], triple[1:], follows)
    behind = always_same(triple[1:], triple[:-1], follows)
    first = np.append(True, ~follows)
    opening = np.zeros(int(triple.max()) + 1, bool)  # so that no chain is a circle
    opening[triple[first]] = True
    head = first | opening[triple]
    head[1:] |= ~(ahead & behind)
    begin = np.flatnonzero(head)
    symbol = alike(triple[begin], np.diff(np.append(begin, len(triple))))
    found = set()
    edges = np.flatnonzero(np.append(own[begin][1:] != own[begin][:-1], True)) + 1
    for a, b in zip(np.append(0, edges[:-1]).tolist(), edges.tolist()):
        if b - a < 2:
            continue
        starts = place[begin[a:b]].tolist()
        low, high = starts[0], place[begin[b] - 1 if b < len(begin) else len(place) - 1] + 3
        starts.append(int(high) - 2)
        local = w[low:high]
        for s, n, p in repetitions(symbol[a:b].tolist()):
            start, end, period = starts[s] - low, starts[s + n] - low + 2, starts[s + p] - starts[s]
            start, end = extended(local, start, end, period)
            if end - start >= max(least_words, least_periods * period):
                found.add((int(at[low]) + start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def extended(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    while start > 0 and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while end < len(words) and words[end] == words[end - period]:
        end += 1
    return start, end


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """For each row of docs: record (its columns, or those of carry), n_words, runs and collapsed.

    Words are parted by ASCII white space. runs are all (start, length, period), in words, of stretches that repeat with
    that smallest period and cannot be extended, at least least_words and least_periods periods long; by start, then
    period. collapsed is the text's words, joined by one space, without those that a run holds behind its first period.
    Null counts as empty: no words, no runs and an empty collapsed text. Repeated rows each have theirs; an empty table
    gives no rows. Rows stay where they are, so no source is too common; a text is one task's work, n log n in the symbols
    of its repeated stretches.
    """
    rows = with_text(docs, text_col, carry)
    run = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("start", "length", "period")])
    schema = rows.select("record", F.lit(0).cast("long").alias("n_words"), F.array(run).alias("runs"), F.lit("").alias("collapsed")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record = batch.column("record")
            field = record.type.get_field_index(text_col)
            texts = pc.fill_null(record.field(field) if field >= 0 else batch.column("text"), "")
            parts = pc.ascii_split_whitespace(texts)
            listed = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
            real = pc.greater(pc.binary_length(parts.values), 0)  # an empty word stands before leading white space
            piece, values = listed[np.asarray(real)], parts.values.filter(real)
            first = np.searchsorted(piece, np.arange(len(texts) + 1))
            runs = runs_of(values.dictionary_encode().indices.to_numpy().astype(np.int64), piece, least_words, least_periods)
            start, length, period = np.array(runs, np.int64).reshape(-1, 3).T
            dropped = np.zeros(len(values) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            stay = np.cumsum(dropped)[:-1] == 0
            left = np.append(0, np.cumsum(np.bincount(piece[stay], minlength=len(texts))))
            offsets = pa.int64() if pa.types.is_large_string(values.type) else pa.int32()
            make = pa.LargeListArray if offsets == pa.int64() else pa.ListArray
            collapsed = pc.binary_join(make.from_arrays(pa.array(left, offsets), values.filter(pa.array(stay))), pa.scalar(" ", values.type))
            doc = piece[start] if len(start) else start
            places = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))), pa.int32())
            spans = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            out = [record, pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(places, spans).cast(kind), collapsed.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["record", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(work, schema)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The texts of the contract: one in ten, chosen by its id's checksum, repeats its words from some place on. A null id
    chooses nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    chosen = chosen.select("doc_id", "text", "words", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).alias("a"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    chosen = chosen.withColumn("p", p)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")), carry=["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    out = found.select(
        F.col("record.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"),
        digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
    length = -F.col("longest.shorter")
    milli = F.floor((1000 * length - (1000 * length) % F.col("longest.period")) / F.col("longest.period"))
    return out.select("doc_id", "n_runs", "longest.start", length.alias("length"), "longest.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
