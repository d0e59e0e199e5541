import random
import re

import numpy as np

from evidarium.llm import decontaminate
from evidarium.llm.decontaminate import contamination

SCHEMA, ITEMS = "doc_id long, text string, items string, runs int", "item_id long, text string, n string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, t, *_ in items:
            x = words(t)
            n = min(10, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else ()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        out.append((i, len(w), sorted(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


def ours(spark, docs, items, **options):
    rows = contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS), **options).select("record.doc_id", "n_words", "runs", "items").collect()
    assert all(a[1] < b[0] for r in rows for a, b in zip(r["runs"], r["runs"][1:]))
    return sorted(((r[0], r[1], [p for a, b in r[2] for p in range(a, b)], sorted(map(str, r[3]))) for r in rows), key=repr)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    for vocabulary, bits in ((3, 1 << 28), (12, 1 << 28), (400, 1 << 15)):
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        monkeypatch.setattr(decontaminate, "COUNTED", 50)
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", 2000)
        text = lambda n: " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
        items = [(k, text(rng.choice([0, 1, 2, 3, 5, 10, 11, 14])), "x") for k in range(12)] + [(3, text(11), "x"), (None, text(12), "x"), (50, None, "x")]
        docs = []
        for k in range(40):
            body = [text(rng.randrange(30)) for _ in range(3)]
            for _ in range(rng.randrange(3)):
                body.insert(rng.randrange(len(body) + 1), rng.choice(items)[1] or "")
            docs.append((k, ", ".join(body).upper() if k % 2 else "\n".join(body), "x", 1))
        docs += [(None, None, "x", 1), (7, "", "x", 1), (7, items[5][1], "x", 1), (8, (items[13][1] + " é ") * 500, "x", 1)]
        assert ours(spark, docs, items) == brute(docs, items)


def test_word_characters(spark):
    docs = [(1, "L’École—n°5: α_β a\x00b 10,000 ＡＢ", "x", 1)]
    items = [(1, "école—n°5", "x"), (2, "α", "x"), (3, "10 000", "x")]
    assert ours(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs = [(1, "Two words", "x", 1), (2, None, "x", 1)]
    assert ours(spark, docs, [(1, None, "x")]) == brute(docs, [])
    assert ours(spark, [], [(1, "two", "x")]) == []


def test_a_blunt_sieve_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 3)
    monkeypatch.setattr(decontaminate, "BITMAP", 1 << 3)
    monkeypatch.setattr(decontaminate, "sieve_of", lambda shingles: decontaminate.Sieve([1, 2, 3], 8, *np.full((2, 1), 255, np.uint8)))
    docs = [(k, " ".join(f"w{(k * i) % 17}" for i in range(60)), "x", 1) for k in range(12)]
    items = [(1, docs[3][1][20:90], "x"), (2, "w0 w1", "x")]
    assert ours(spark, docs, items) == brute(docs, items)


def test_passes_do_not_depend_on_the_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1)], SCHEMA)
    plans = []
    for n in (1, 3000):
        items = spark.createDataFrame([(k, f"item {k} " + " ".join(f"{k}w{i}" for i in range(20)), "x") for k in range(n)], ITEMS)
        plans.append(contamination(docs, items)._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
    assert plans[0] == plans[1]
