import zlib

from pyspark.sql import functions as F

from evidarium.llm.shard import permuted, place_of, shard

SCHEMA = "doc_id long, text string, size string, n string"


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 5, 12, 17, 101, 1000):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), 7)).collect()]
        assert sorted(got) == list(range(n))
        assert got == [s * 3 + k for k, s in (place_of(i, n, 3, 7) for i in range(n))]


def test_shards_and_slots(spark):
    rows = [(i * 3 % 101, f"text é {i}" * (i % 4), "x", "y") for i in range(101)] + [(None, None, "x", "y"), (None, "", "x", "y"), (5, "again", "x", "y"), (5, "again", "x", "y"), (200, "long " * 40_000, "x", "y")]
    out = shard(spark.createDataFrame(rows, SCHEMA), shards=7, seed=3).collect()
    assert len(out) == len(rows)
    slots = [sorted(r["slot"] for r in out if r["shard"] == k) for k in range(7)]
    assert all(x == list(range(len(x))) for x in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in out), key=repr) == want
    assert all((r["shard"], r["slot"]) == place_of(r["row_number"], len(rows), 7, 3) for r in out)
    ids = [r["id"] for r in sorted(out, key=lambda r: r["row_number"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_same_places_whatever_the_partitions(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one = {tuple(r) for r in shard(docs.repartition(1)).collect()}
    assert one == {tuple(r) for r in shard(docs.repartition(9)).collect()}


def test_more_shards_than_rows_and_empty_table(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
    out = shard(spark.createDataFrame([(1, "a", "", ""), (2, "b", "", "")], SCHEMA)).collect()
    assert sorted(r["shard"] for r in out) == [0, 1] and {r["slot"] for r in out} == {0}
