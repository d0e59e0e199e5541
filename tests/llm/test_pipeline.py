import hashlib
import random
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from evidarium.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text):
    return (i, text, "en", "s", len(text) if text else 0)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_filters_take_effect_and_keep_the_columns(spark, sf):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = text(80), text(60), text(40)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [row(5, a), row(2, a.replace(" ", "\n")), row(9, b), row(3, b + " tail"), row(7, c + " " + bench), row(8, None), row(8, c), row(8, "other " + text(30)), row(None, text(9))]
    docs = spark.createDataFrame(rows, SCHEMA)
    once = pipeline.without_copies(spark, docs, sf)
    assert rows_of(once) == sorted([r for r in rows if r[0] != 5], key=repr)
    near = pipeline.without_near_copies(spark, docs, sf)
    assert rows_of(near) == sorted([r for r in rows if r[0] not in (5, 9)], key=repr)
    clean = pipeline.without_benchmarks(spark, docs, sf)
    assert rows_of(clean) == sorted([r for r in rows if r[0] != 7], key=repr)
    assert near.columns == once.columns == clean.columns == docs.columns


def test_each_filter_keeps_one_of_repeated_rows(spark, sf):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = text(80), text(60), text(50)
    rows = [(4, a, "x", 1, 7)] * 3 + [(2, b, "y", 2, 8)] * 2 + [(6, b + " tail", "y", 2, 8), (None, c, "z", None, None), (None, c, "z", None, None), (5, c, "z", 3, 9), (7, None, None, 1, 1), (7, None, None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string, gone int, row int")
    near = pipeline.without_near_copies(spark, docs, sf)
    assert near.columns == docs.columns
    assert rows_of(near) == sorted([rows[0], rows[3], rows[8], rows[9], rows[10]], key=repr)  # texts without words are no copies here
    once = pipeline.without_copies(spark, docs, sf)
    assert rows_of(once) == sorted([rows[0], rows[3], rows[5], rows[8], rows[9]], key=repr)


LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def windows(text, whole):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
    found = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in range(1, 11)}
    return ({tuple(words)} if 0 < len(words) < 10 else found[10]) if whole else set().union(*found.values())


def expected(texts, benchmark):
    """What the stages after the classifier keep, by looking at all pairs."""
    once, seen = {}, set()
    for i in sorted(texts):
        text = re.sub(r"[\x20\x09-\x0D]+", " ", texts[i])
        if text not in seen:
            seen.add(text)
            once[i] = texts[i]
    sets, root = {i: shingles(t) for i, t in once.items()}, {i: i for i in once}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    held = set().union(*[windows(b, True) for b in benchmark])
    return {i for i in once if top(i) == i and not held & windows(once[i], False)}


def test_run_keeps_clean_documents_and_encodes_them(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = pipeline.run(spark, sf).collect()
    assert 0 < len(out) < len(docs)
    good = {r["doc_id"]: r["text"] or "" for r in pipeline.good_quality(spark, table, sf).collect()}
    benchmark = [r["text"] or "" for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert len(out) == len({r["doc_id"] for r in out}) and {r["doc_id"] for r in out} == expected(good, benchmark)
    t = Tokenizer.from_file(default_vocabulary())
    for r in out:
        ids = t.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert np.mean([labels.get(r["doc_id"], 1) for r in out]) > 0.97
    assert rows_of(pipeline.run(spark, sf)) == sorted(map(tuple, out), key=repr)


def test_each_stage_on_an_empty_table(spark, sf):
    empty = spark.createDataFrame([], SCHEMA)
    for _, work in pipeline.STAGES:
        assert work(spark, empty, sf).count() == 0
