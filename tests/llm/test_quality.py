import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidarium.llm.quality import SAMPLE_LINES, fit, forward_backward, line_features, quality, train

SCHEMA = "doc_id long, text string, score string, label int"


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(1)
    count = np.array([1, 4, 3, 5, 2])
    good, ties = rng.normal(size=count.sum()), rng.normal(size=(2, 2))
    probability, pairs = forward_backward(good, count, ties)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in count:
        e = good[at : at + n]
        at += n
        total, mass, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] for i in range(n) if y[i]) + sum(ties[a, b] for a, b in zip(y, y[1:])))
            total += w
            mass += w * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += w
        want += list(mass / total)
        want_pairs += both / total
    assert np.allclose(probability, want) and np.allclose(pairs, want_pairs)


def test_features_see_neighbours_only_inside_a_text():
    x, size, count = line_features([b"one line", b"", b"a\nb b\na", "é | é\n".encode()])
    assert count.tolist() == [1, 1, 3, 2] and len(x) == 7 and size.tolist() == [8, 0, 1, 3, 1, 7, 0]
    alone, _, _ = line_features([b"a\nb b\na"])
    assert np.array_equal(x[2:5], alone)
    assert not x[0, 16:48].any()


def tables(spark, n=240):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(words, 8)) + "." for _ in range(rng.integers(1, 6))]
        if i % 3 == 0:
            lines = [" ".join(np.repeat(rng.choice(words, 3), 4)) for _ in lines]
        rows.append((i, "\n".join(lines), "x", 1))
    return rows, [(i, int(i % 3 > 0)) for i in range(n)]


def test_held_out_documents(spark):
    rows, labels = tables(spark)
    extra = [(None, None, "x", 1), (9000, None, "x", 1), (9001, "", "x", 1), (0, "twice", "x", 1), (9002, "long line " * 20_000, "x", 1), (9003, "l\n" * 30_000, "x", 1)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 1), (7, 1)], "doc_id long, quality int")
    out = quality(docs, train(docs, known)).select("record.doc_id", "score", "record.score").collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r[1] <= 1 for r in out)
    score, truth = {r[0]: r[1] for r in out}, dict(labels)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1 and i]
    assert np.mean([(score[i] >= 0.5) == truth[i] for i in held]) > 0.97


def test_held_out_labels_are_not_learned(spark):
    rows, labels = tables(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "text", "x", 1)], SCHEMA)
    field = train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r[1] for r in quality(docs, field).collect()] == [0.5]
    assert quality(docs.limit(0), field).count() == 0


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_kind(label):
    x, size, count = line_features([b"a b", b"c\nd"])
    p = fit(x, size, count, np.array([label, label])).documents(x, size, count)
    assert ((p >= 0.5) == bool(label)).all()


def in_hash_order(spark, ids):
    return [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("cast(id AS string) AS id").orderBy(F.xxhash64("id"), "id").selectExpr("cast(id AS long)").collect()]


def test_long_texts_do_not_push_out_those_behind_them(spark):
    rows, labels = tables(spark)
    learned = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    first = in_hash_order(spark, learned)[0]
    longer = [(i, "l\n" * SAMPLE_LINES if i == first else text, a, b) for i, text, a, b in rows]
    a = train(spark.createDataFrame(longer, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"))
    b = train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([x for x in labels if x[0] != first], "doc_id long, quality int"))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_a_label_of_long_texts_only_is_learned(spark):
    rows, labels = tables(spark)
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    bad = [i for i, y in learned if not y]
    long_ = [(i, text + "\nx x x" * (SAMPLE_LINES + k)) for k, (i, text) in enumerate((i, dict((r[0], r[1]) for r in rows)[i]) for i in bad[:2])]
    docs = spark.createDataFrame([(i, text, "x", 1) for i, text in long_] + [r for r in rows if r[0] % 3], SCHEMA)
    field = train(docs, spark.createDataFrame([x for x in learned if x[1]] + [(i, 0) for i in bad[:2]], "doc_id long, quality int"))
    score = {r[0]: r[1] for r in quality(docs, field).select("record.doc_id", "score").collect()}
    assert score[bad[0]] < 0.5 and np.mean([score[i] >= 0.5 for i, y in learned if y]) > 0.97


def test_equal_rows_count_each(spark):
    rows, labels = tables(spark, 60)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    once, twice = (train(spark.createDataFrame(r, SCHEMA), known) for r in (rows, rows + rows))
    assert np.allclose(once.weights, twice.weights, atol=1e-3)


def test_runs_of_lines_change_nothing(monkeypatch):
    import evidarium.llm.quality as op

    rng = np.random.default_rng(4)
    parts = [b"", b"one line.", b"a b a", b"#$%", b"Big 12|3", "é".encode()]
    texts = [b"\n".join(parts[i] for i in rng.integers(0, 6, rng.integers(1, 40))) for _ in range(60)] + [b"", b"\n", b"\n\n"]
    x, size, count = line_features(texts)
    assert count.tolist() == [t.count(b"\n") + 1 for t in texts]
    for most in (1, 2, 7, 40, 1000):
        monkeypatch.setattr(op, "RUN_LINES", most)
        assert all(np.array_equal(a, b) for a, b in zip(line_features(texts), (x, size, count)))
    monkeypatch.setattr(op, "WINDOW", 16)
    assert all(np.array_equal(a, b) for a, b in zip(line_features(texts), (x, size, count)))
    monkeypatch.setattr(op, "RUN_LINES", 5)
    field = op.Field(x.mean(axis=0), np.maximum(x.std(axis=0), 0.01), rng.normal(size=x.shape[1]), rng.normal(size=(2, 2)), 1.0, 0.0)
    want = field.documents(x, size, count)
    for long in (0, 1, 3, 10):
        monkeypatch.setattr(op, "LONG_CHAIN", long)
        assert np.allclose(field.score(texts), want, atol=1e-9)


def test_long_chains_in_lanes():
    from evidarium.llm.quality import LONG_CHAIN, marginals

    rng = np.random.default_rng(5)
    for strength in (0.1, 1, 6):
        count = np.array([3, LONG_CHAIN + 1, 1, 3 * LONG_CHAIN + 77])
        good, ties = rng.normal(size=count.sum()) * 3, rng.normal(size=(2, 2)) * strength
        assert np.allclose(marginals(good, count, ties), forward_backward(good, count, ties)[0], atol=1e-8)


def test_five_megabytes_of_line_feeds():
    import time
    import tracemalloc

    import evidarium.llm.quality as op

    rng = np.random.default_rng(6)
    width = 3 * op.OWN + 3
    field = op.Field(np.zeros(width, np.float32), np.ones(width, np.float32), rng.normal(size=width), rng.normal(size=(2, 2)), 1.0, 0.0)
    begun = time.time()
    tracemalloc.start()
    score = field.score([b"\n" * (5 << 20), b"ok\n" * 500_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and time.time() - begun < 120 and ((score > 0) & (score < 1)).all()
