"""From raw documents to token ids: quality, exact copies, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last keep the columns of documents and only leave rows out. The tables that a stage wrote for
itself in the shared folder go when the next one begins, as its result is in a table of its own by then.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidarium.llm import bpe, decontaminate, exact_dedup, jaccard, quality
from evidarium.llm.common import discard, materialize, packed, recorded, table, unpacked
from evidarium.llm.tokens import default_vocabulary

#: The tables that the last stage of a run wrote for itself, by session, input and thread: runs do not touch each other's.
_own: dict[tuple, list[str]] = {}


def stage(work):
    """Discards what the stage before wrote for itself, unless docs still reads it."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run = (id(spark), sf_dir, threading.get_ident())
        read = docs.inputFiles()
        before = _own.pop(run, [])
        kept = [p for p in before if any(p.rsplit("/", 1)[-1] in f for f in read)]
        discard(spark, [p for p in before if p not in kept])
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _own[run] = kept + paths
        return out

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return run_stage


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject (score of 0.5 or more). Every row is judged by its own text, so
    repeated rows stay or go together; a null text counts as empty and gets a score; with no label at all, all stay. An
    empty table stays empty."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.quality(docs, field).where("score >= 0.5"), docs)


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of ASCII white space as one space, null as empty) the row with the smallest id; rows without an
    id come last, and of rows that share the id, or are repeated whole, one stays. An empty table stays empty."""
    return unpacked(exact_dedup.exact_dedup(docs).where("kept"), docs)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the one row with the smallest id. Rows get a written number, as ids and whole rows
    may repeat; only numbers, ids and texts go through the join, and the rows that it drops are taken out by number. Of
    rows that share the smallest id the first stays; texts without words, null ones too, are similar to none and all stay.
    An empty table stays empty."""
    rows = materialize(packed(docs, row=F.monotonically_increasing_id()), "pipeline-rows")
    found = jaccard.near_duplicates(rows.select("row", "record.doc_id", "record.text"), carry=["row"])
    dropped = found.where("not kept").select("record.row")
    return unpacked(rows.join(dropped, "row", "left_anti"), docs)


@stage
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows with a null text, or none with words, have none and stay, as all
    do if the benchmark is empty; repeated rows stay or go together. An empty table stays empty."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(F.size("runs") == 0), docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and of the
    decoded text. Null and empty texts have no ids; an empty table gives no rows."""
    found = bpe.encoded(docs, default_vocabulary(), carry=["doc_id"])
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return found.select("record.doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmarks),
    ("bpe_encoding", token_ids),
]

#: The classifier is trained, so SQL cannot say which rows stay; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = work(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
