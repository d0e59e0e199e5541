import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from evidarium.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, digest string, record int"


def expected(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


ROWS = [
    (5, "a  b", "x", 1), (3, "a\tb", None, 2), (9, "a b ", "x", 3), (1, None, "x", 4), (2, "", "x", 5), (4, "é b", "x", 6),
    (7, "w " * 50_000, "x", 7), (6, "w\n" * 50_000, "x", 8), (None, "a b", "x", 9), (None, "lonely", "x", 10), (8, "same", "x", 11), (8, "same", "x", 12),
]


def found(spark, rows, **options):
    out = exact_dedup(spark.createDataFrame(rows, SCHEMA), **options).select("record.doc_id", "keep_id", "group_size", "content_sha256", "kept", "record.record").collect()
    assert sorted(r[5] for r in out) == sorted(r[3] for r in rows)  # each input row once
    return out


def kept_once(out):
    by = defaultdict(list)
    for r in out:
        by[r[3]].append(r[4])
    return all(sum(x) == 1 for x in by.values())


def test_nulls_ties_repeats_and_long_texts(spark):
    out = found(spark, ROWS)
    assert sorted((tuple(r[:4]) for r in out), key=repr) == expected(ROWS)
    assert kept_once(out)
    assert all(r[0] == r[1] for r in out if r[4])


def test_colliding_digests_are_told_apart_by_content(spark):
    out = found(spark, ROWS, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))
    assert sorted((tuple(r[:4]) for r in out), key=repr) == expected(ROWS)
    assert kept_once(out)
    out = found(spark, ROWS, digest=lambda c: F.lit("one"))
    assert sorted((tuple(r[:4]) for r in out), key=repr) == expected(ROWS)
    assert kept_once(out)


def test_state_lasts_across_batches(spark):
    rows = [(100 - i, f"t{i % 7}", None, i) for i in range(60)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    out = found(spark, rows, files_per_batch=1)
    assert sorted((tuple(r[:4]) for r in out), key=repr) == expected(rows)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
