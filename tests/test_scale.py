from evidarium.operators.keywords import keyword_matches
from evidarium.plans import analog, catalog
from evidarium.plans.analog import BASE, VIEWS, Catalog


def test_placements_are_those_of_the_sql_in_tasks_of_bounded_length(spark, sf, monkeypatch):
    c = Catalog(spark, sf)
    text = VIEWS["placements"]
    want = spark.sql(text, **{b: getattr(c, b) for b in BASE if "{" + b + "}" in text})
    monkeypatch.setattr(analog, "TASK_LINES", 300)
    got = Catalog(spark, sf).placements
    assert got.dtypes == want.dtypes and got.count() == want.count() > 1000
    assert got.exceptAll(want).isEmpty()
    # As many tasks as the lines need, whatever spark.sql.shuffle.partitions says; none with many more than its share.
    spread = [r["n"] for r in got.selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
    assert len(spread) >= c.lineitem.count() // 300 * 0.8 and max(spread) < 900


def test_edges_go_through_placements_once(spark, sf):
    plan = catalog.edges(Catalog(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_few_keywords_are_broadcast_and_texts_stay_where_they_are(spark):
    # The keywords come from a table much larger than they are, so only their written form tells how few there are.
    many = spark.range(2_000_000).selectExpr("concat('word', id % 40, ' of') AS keyword")
    texts = spark.range(200).selectExpr("id", "concat('A Word', id, ' of_ＷＯＲＤ', id % 50) AS t", "true AS f")
    found = keyword_matches(texts, many, "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pythonUDF") and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted(map(tuple, found.collect())) == [(k, f"word{k} of") for k in range(40)]
