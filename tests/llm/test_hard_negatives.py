import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from evidarium.llm.hard_negatives import LEAST, MOST, ORACLE, Packed, first_of, hard_negatives, op12_hard_negatives, whole_components

SCHEMA = "vec_id long, embedding array<double>, label int, row string, id int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_packed_scores_are_exact():
    rng = np.random.default_rng(1)
    for reach in (1, 90, 3000, 2**20, 2**28):
        for n in (1, 2, 7, 50):
            rows, anchors = rng.integers(-reach, reach + 1, (n, 9)), rng.integers(-reach, reach + 1, (5, 9))
            assert Packed(rows).scores(anchors).tolist() == [[sum(a * b for a, b in zip(x, y)) for y in rows.tolist()] for x in anchors.tolist()]
    wide = whole_components(np.array([[1e12, -3e11, 0.5], [2.0, 1e15, -1e15]]), 256)
    assert Packed(wide).scores(wide[:1])[0].tolist() == [max(min(sum(a * b for a, b in zip(wide[0], y)), MOST), LEAST) for y in wide.tolist()]
    assert Packed(wide).scores(-wide[1:])[0, 1] == LEAST
    assert Packed(np.zeros((0, 3), np.int64)).scores(np.zeros((2, 3), np.int64)).shape == (2, 0)


def test_first_of_ties():
    scores = np.array([[5, 7, 7, 1, 7], [0, 0, 0, 0, 0]])
    a, c = first_of(scores, np.array([[True] * 5, [True, False, False, True, True]]), 2)
    assert list(zip(a.tolist(), c.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 3)]


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100):
    kept = [(k, i, [math.floor(256 * x) for x in v], label) for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, i, v, label in kept:
        if not anchors(i):
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, same == label) for q, j, w, same in kept if q != k), key=order)
        for score, j, _ in [x for x in scored if x[2]][:positives]:
            near = [x for x in scored if not x[2] and low * score <= 100 * x[0] <= high * score][:negatives]
            out += [(i, j, r + 1, n, score, s) for r, (s, n, _) in enumerate(near)]
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    import evidarium.llm.hard_negatives as op

    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), [rng.choice([-0.5, -0.1, 0.0, 0.2, 0.2, 0.7]) for _ in range(rng.choice([3, 4, 4, 4]))], rng.choice([None, -1, 0, 1, 2])) for _ in range(300)]
    rows += [(7, [0.1, None, 0.2, 0.3], 1), (8, None, 1), (9, [float("nan"), 0.0, 0.0, 0.0], 1), (10, [float("inf"), 0.0, 0.0, 0.0], 1), (11, [], 1), (12, [1e308, 0.0], 0), (4, [0.2] * 4, 1), (4, [0.2] * 4, 1), (4, [0.2] * 4, 2)]
    rows += [(k, [0.7, 0.2, 0.7, 0.2], k % 3) for k in range(500, 540)]  # a group of copies
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    for size in (5, 8192):
        monkeypatch.setattr(op, "BLOCK_ROWS", size)
        monkeypatch.setattr(op, "BATCH_ANCHORS", size)
        got = hard_negatives(df, F.col("vec_id") % 4 == 0)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, lambda i: i is not None and i % 4 == 0)
    got = hard_negatives(df, F.col("vec_id") % 5 == 0, 2, 3, 50, 90)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, lambda i: i is not None and i % 5 == 0, 2, 3, 50, 90)
    assert hard_negatives(df, F.lit(False)).count() == hard_negatives(df.limit(0), F.lit(True)).count() == 0


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE})").fetchall()
    got = op12_hard_negatives(spark, sf)
    assert got.dtypes == [(c, "int" if c == "rank" else "bigint") for c in COLUMNS]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
