import json

from pyspark.sql import types as T

from evidarium.sources.snapshots import Snapshot
from evidarium.streaming.intake import event_windows, merge_stream, new_contents

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("sha256", "title", "notes")])


def test_intake_merges_batch_by_batch(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    full = T.StructType.fromDDL("sha256 string, title string, notes string, seen_at timestamp")

    def arrive(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("sha256", "title", "notes", "seen_at"), r))) for r in rows))

    def run():
        merge_stream(new_contents(spark, str(source), full), str(root), str(tmp_path / "check"), SCHEMA)

    arrive("a.json", ("h1", None, "n1", "2026-01-01T00:00:00"), ("h1", "x", "n1", "2026-01-01T01:00:00"), (None, "y", "z", "2026-01-01T00:00:00"))
    run()
    arrive("b.json", ("h2", "two", "n2", "2026-01-01T02:00:00"), ("h1", "again", "n3", "2026-01-01T02:00:00"))
    run()
    last = Snapshot.open(spark, str(root)).read()
    got = {r["sha256"]: r["notes"] for r in last.collect()}
    assert got == {"h1": "n1", "h2": "n2"}


def test_event_windows_on_a_table(spark, sf):
    out = event_windows(spark.read.parquet(f"{sf}/events.parquet"), "1 day", "1 hour")
    assert out.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
