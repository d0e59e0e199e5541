import random

from pyspark.sql import functions as F

from evidarium.plans import catalog, search
from evidarium.plans.analog import Catalog


def plain(df):
    return sorted((tuple(r) for r in df.select("query_id", "type", "id", "title", "subtitle", "badges", "place").collect()), key=repr)


def test_index_finds_what_the_scan_finds(spark, sf, tmp_path):
    c = Catalog(spark, sf)
    rng = random.Random(1)
    titles = [r[0] for r in catalog.entity_index(c).select("title").distinct().collect() if r[0]]
    texts = []
    for k in range(900):
        title = rng.choice(titles)
        a = rng.randrange(len(title))
        texts.append(rng.choice([title[a : a + rng.randrange(2, 7)], title[a : a + 3].upper() + "%", "_" + title[a + 1 : a + 6], title[a] + "%" + title[-1]]))
    texts += ["", " ", "a", None, "%%", "__", "zzz", "zzzzzz", "\\", "a\\b", "brand#", "é", "ring", "RING"]
    rows = [(k, t, [None, [], ["kit"], ["part", "image"], ["nothing"]][k % 5], [None, 1, 7, 500, 0][k % 7 % 5]) for k, t in enumerate(texts)]
    asked = spark.createDataFrame(rows, "query_id long, text string, types array<string>, limit int")
    index = search.catalog_index(c)
    want = plain(catalog.search(c, asked))
    assert want and plain(search.search_index(index, asked)) == want
    index.write(f"{tmp_path}/index")
    assert plain(search.search_index(search.open_index(spark, f"{tmp_path}/index"), asked, 2, 3)) == plain(catalog.search(c, asked, 2, 3))


def test_ten_thousand_queries_without_a_nested_loop(spark, sf):
    c = Catalog(spark, sf)
    asked = spark.range(10_000).select(F.col("id").alias("query_id"), F.concat(F.lit("ring "), F.col("id").cast("string")).alias("text"))
    plan = search.search_index(search.catalog_index(c), asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_entities_that_share_a_text(spark):
    rows = [("part", k, f"title {k:04d}", "shared", []) for k in range(500)] + [("kit", 1, None, None, []), ("kit", 2, "shared", "shared", []), ("map", 3, "ab", "", [])]
    index = search.build_index(spark.createDataFrame(rows, "type string, id long, title string, subtitle string, badges array<string>"))
    assert index.holders.where("type = 'part'").join(index.texts.where("low = 'shared'"), "text_id").count() == search.MOST
    asked = spark.createDataFrame([(1, "hare"), (2, "ab"), (3, "title 04_9")], "query_id long, text string")
    got = plain(search.search_index(index, asked, 3, 20, ("part", "kit", "map")))
    assert [(r[0], r[1], r[2], r[6]) for r in got] == [(1, "kit", 2, 1), (1, "part", 0, 2), (1, "part", 1, 3), (1, "part", 2, 4), (2, "map", 3, 1), (3, "part", 409, 1), (3, "part", 419, 2), (3, "part", 429, 3)]
    empty = search.build_index(spark.createDataFrame([], "type string, id long, title string, subtitle string, badges array<string>"))
    assert search.search_index(empty, asked).count() == 0


def test_a_text_that_many_ask_for_is_compared_once(spark, sf):
    c = Catalog(spark, sf)
    asked = spark.range(3000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "ring").otherwise("e ").alias("text"))
    found = catalog.search(c, asked)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("like") <= 2  # title and subtitle
    assert plain(found) == plain(search.search_index(search.catalog_index(c), asked))
    twice = spark.createDataFrame([(1, "ring"), (1, "ring"), (1, "e ")], "query_id long, text string")
    assert [r["place"] for r in catalog.search(c, twice, 2).orderBy("place").collect()] == list(range(1, catalog.search(c, twice, 2).count() + 1))
