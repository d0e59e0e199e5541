"""Secret scans: all rules in one automaton and one pass over the bytes.

The automaton (see automaton.py) gives the spans of every rule's matches: leftmost, as long as can be and non-overlapping
for each kind. Those too short for their kind are dropped, without another try inside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import table, texts_in, with_text

GROUP_BYTES = 8 << 20


def either_case(words: bytes) -> bytes:
    return re.sub(rb"[a-z]", lambda m: b"[%c%c]" % (m[0][0] - 32, m[0][0]), words)


class Secret(NamedTuple):
    pattern: bytes
    #: Least length of a match.
    least: int
    #: Whether only the value counts for that: what follows from the first byte with which the match could end.
    value_only: bool = False


KEYS = either_case(b"(password|passwd|secret|token|api_?key)")
RULES: dict[str, Secret] = {
    "assign": Secret(KEYS + rb"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, value_only=True),
    "access": Secret(rb"AKIA[A-Z0-9]+", 20),
    "hex": Secret(rb"[0-9a-f]+", 24),
    "forge": Secret(rb"gh[pousr]_[A-Za-z0-9]+", 24),
    "chat": Secret(rb"xox[abprs]-[A-Za-z0-9-]+", 15),
    "webtoken": Secret(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)?", 24),
    "pem": Secret(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
}
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: dict[str, Secret]):
        self.kinds, self.rules = list(rules), list(rules.values())
        self.automaton = Automaton([r.pattern for r in self.rules])

    def scan(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """Spans (start, kind, end; in characters) of the texts that have any, by the text's number."""
        whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(size)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for kind, begin, early, end in self.automaton.matches(whole):
            rule = self.rules[kind]
            long = end - (early - 1 if rule.value_only else begin) >= rule.least
            begin, end = begin[long], end[long]
            doc = np.searchsorted(ends, begin, "right")
            first = (ends - size)[doc]
            for d, a, b in zip(doc.tolist(), (begin - first).tolist(), (end - first).tolist()):
                found.setdefault(d, []).append((a, kind, b))
        return {d: in_characters(texts[d], sorted(spans)) for d, spans in found.items()}


def in_characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as spans of code points."""
    if text.isascii():
        return spans
    heads = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    at = lambda i: int(heads[i - 1]) if i else 0
    return [(at(a), k, at(b)) for a, k, b in spans]


def secrets(docs: DataFrame, rules: dict[str, Secret] | None = None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For each row of docs: record (its columns, or those of carry) and spans, an array of (start, end, kind) by start,
    then kind in the order of the rules. start and end count code points, end exclusive. Null counts as empty; texts
    without a secret have an empty array; repeated rows each have theirs; an empty table gives no rows. Rows stay where
    they are: no text is too long, and no source too common."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Scanner(rules or RULES))
    rows = with_text(docs, text_col, carry)
    schema = rows.select("record", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("kind"))).alias("spans")).schema
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            out: list[list] = []
            texts, held = [], 0
            for text in [*texts_in(batch, text_col), None]:
                if text is not None:
                    texts.append(text)
                    held += len(text)
                if held >= GROUP_BYTES or text is None:
                    found = scanner.scan(texts)
                    out += [[{"start": a, "end": b, "kind": scanner.kinds[k]} for a, k, b in found.get(i, ())] for i in range(len(texts))]
                    texts, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(out, span)], names=["record", "spans"])

    return rows.mapInArrow(run, schema)


def op10_secret_scan(spark, sf_dir):
    found = secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counted = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [counted(k) for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("record.doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
