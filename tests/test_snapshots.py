import json
import random

import pytest
from pyspark.sql import functions as F

from evidarium.operators.merge import partial_update, set_current
from evidarium.sources.snapshots import Snapshot
from evidarium.streaming.changes import CHOICES, FIELDS, keep_last, last_choices, last_fields, with_choices, with_fields

SCHEMA = "id long, name string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = Snapshot.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], 64)
    assert table.read().count() == 0 and table.versions() == []
    assert table.apply(spark.range(2000).select("id", F.lit("a").alias("name"), F.lit(1).alias("n")), 0) == 1
    ten = spark.createDataFrame([(k * 37, "b", None) for k in range(9)] + [(None, "null", 2)], SCHEMA)
    assert table.apply(ten, 1) == 2 and table.rewritten(2) <= 10
    assert table.apply(ten.withColumn("name", F.lit("c")), 1) == 2  # a replayed batch
    assert table.read(1).where("name <> 'a'").count() == 0 and table.read(1).count() == 2000
    assert rows(table.read().where("name <> 'a'")) == sorted([(k * 37, "b", 1) for k in range(9)] + [(None, "null", 2)], key=repr)
    assert Snapshot.open(spark, f"{tmp_path}/t").read().count() == 2001
    gone = spark.createDataFrame([(k, None, None, True) for k in range(1990)] + [(None, None, None, True), (1995, "stays", 5, None)], "id long, name string, n int, gone boolean")
    assert table.apply(gone, 2, deleted="gone") == 3
    assert rows(table.read()) == [(k, "stays" if k == 1995 else "a", 5 if k == 1995 else 1) for k in range(1990, 2000)]
    assert table.apply(gone.limit(0), 3) == 4 and table.read().count() == 10
    with pytest.raises(ValueError):
        table.read(9)
    table.forget(2)
    assert table.versions() == [3, 4] and table.read(3).count() == table.read().count() == 10
    with pytest.raises(ValueError):
        table.read(1)


def test_a_job_that_is_lost_before_its_manifest_leaves_nothing(spark, tmp_path):
    table = Snapshot.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], 4)
    table.apply(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    spark.createDataFrame([(1, "half", 9)], SCHEMA).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{tmp_path}/t/data/version=2")
    assert rows(table.read()) == [(1, "a", 1)]
    table.apply(spark.createDataFrame([(2, "b", 2)], SCHEMA), 1)
    assert rows(table.read()) == [(1, "a", 1), (2, "b", 2)]


def arrive(folder, name, records):
    (folder / name).write_text("\n".join(map(json.dumps, records)))


def test_shuffled_arrivals_give_the_batch_operators_tables(spark, tmp_path):
    rng = random.Random(1)
    positions = spark.createDataFrame([(k, k % 7, k % 3, "old", k % 2) for k in range(60)], "id long, placement_id long, map_id long, status string, is_current int")
    changes = [{"id": rng.randrange(60), "change_seq": k, "fields": {rng.choice(["status", "is_current"]): rng.choice([None, "1", "x"])}} for k in range(300)]
    changes += [changes[-1], {**changes[-1], "fields": dict.fromkeys(changes[-1]["fields"], "zz")}]
    picks = [{"id": k, "placement_id": k % 7, "map_id": k % 3, "change_seq": rng.randrange(40)} for k in rng.sample(range(60), 50)]
    rng.shuffle(changes), rng.shuffle(picks)
    for folder in ("fields", "picks"):
        (tmp_path / folder).mkdir()
    fields = Snapshot.create(spark, f"{tmp_path}/last-fields", FIELDS, ["id", "field"], 8)
    chosen = Snapshot.create(spark, f"{tmp_path}/last-choices", CHOICES, ["placement_id", "map_id"], 8)
    for k in range(4):  # each time the stream goes on from its state
        arrive(tmp_path / "fields", f"{k}.json", changes[k::4])
        arrive(tmp_path / "picks", f"{k}.json", picks[k::4])
        keep_last(last_fields(spark.readStream.schema("id long, change_seq long, fields map<string, string>").json(f"{tmp_path}/fields")), fields, f"{tmp_path}/c1")
        keep_last(last_choices(spark.readStream.schema("id long, placement_id long, map_id long, change_seq long").json(f"{tmp_path}/picks")), chosen, f"{tmp_path}/c2")
    every = spark.createDataFrame([(c["id"], c["change_seq"], c["fields"]) for c in changes], "id long, change_seq long, fields map<string, string>")
    assert rows(with_fields(positions, fields.read(), ["status", "is_current"])) == rows(partial_update(positions, every, ["status", "is_current"]))
    assert rows(with_choices(positions, chosen.read())) == rows(set_current(positions, spark.createDataFrame([(p["id"], p["change_seq"]) for p in picks], "id long, change_seq long")))
    assert len(fields.versions()) >= 4
