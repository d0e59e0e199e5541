import random

from pyspark.sql import functions as F

from evidarium.operators.pages import children_pages, numbered_within


def test_numbers_within_keys(spark):
    rng = random.Random(1)
    for shape in ([0] * 400, list(range(300)), [rng.choice([None, 1, 2, 2, 2, 9]) for _ in range(500)], [5]):
        rows = [(k, rng.randrange(50), "x") for k in shape]
        got = numbered_within(spark.createDataFrame(rows, "k int, v int, _x string").repartition(7), ["k"], [F.desc("v")]).collect()
        assert len(got) == len(rows)
        for k in set(shape):
            own = sorted((r for r in got if r["k"] == k), key=lambda r: r["number"])
            assert [r["number"] for r in own] == list(range(1, len(own) + 1))
            assert [r["v"] for r in own] == sorted((v for q, v, _ in rows if q == k), reverse=True)
    through = numbered_within(spark.range(1000).repartition(5), [], [F.desc("id")]).collect()
    assert sorted((r["number"], r["id"]) for r in through) == [(k + 1, 999 - k) for k in range(1000)]
    assert numbered_within(spark.range(0), [], [F.asc("id")]).count() == 0


def test_a_million_children_in_pages(spark):
    many = spark.range(1_000_000).select(F.lit(7).alias("kit"), F.col("id").alias("part"), F.lit("p").alias("label"))
    few = spark.createDataFrame([(8, 2, "b"), (8, 1, "a"), (8, 1, "a"), (None, 3, "c")], "kit int, part long, label string")
    pages = children_pages(many.unionByName(few), "kit", "parts", "part", "label", size=1000)
    sizes = {(r["kit"], r["page"]): (r["n"], r["first"]) for r in pages.select("kit", "page", F.size("parts").alias("n"), F.col("parts")[0]["part"].alias("first")).collect()}
    assert sizes == {(7, k): (1000, 1000 * k) for k in range(1000)} | {(8, 0): (3, 1)}
    last = children_pages(few, "kit", "parts", "part", "label", size=2, newest=True).collect()
    assert sorted((r["page"], [tuple(p) for p in r["parts"]]) for r in last) == [(0, [(2, "b"), (1, "a")]), (1, [(1, "a")])]
