import hashlib
import random
import zlib

import numpy as np
import pytest

from evidarium.llm.periodic import op13_periodic_runs, periodic_runs, runs_of
from evidarium.llm.suffix_automaton import repetitions


def brute(words, least=6, periods=4):
    """Every maximal stretch for every distance; the smallest distance of a stretch is its period."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q) and not any(a <= i and j + q <= a + l and q % p == 0 for a, l, p in out):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(5)
    for size in (2, 3, 8):
        yield from ([rng.randrange(size) for _ in range(rng.randrange(60))] for _ in range(150))
    for _ in range(300):  # powers of random words, with and without faults
        out = []
        for _ in range(rng.randrange(1, 5)):
            word = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(1, 9))]
            out += [rng.randrange(5) for _ in range(rng.randrange(4))] + word * rng.randrange(1, 8) + word[: rng.randrange(len(word) + 1)]
        if rng.random() < 0.4:
            out[rng.randrange(len(out))] = 99
        yield out
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    yield b  # the Fibonacci word has many runs, but none of four periods
    yield [0] * 300
    yield [0, 1] * 100 + [0] * 50 + [0, 1, 2] * 40


def test_repetitions_are_all_maximal_squares():
    for words in sequences():
        if len(words) <= 150:
            assert repetitions(words) == brute(words, 2, 2)


def test_runs_against_brute_force():
    many, pieces, want = [], [], []
    for k, words in enumerate(sequences()):
        assert runs_of(np.array(words, np.int64), np.zeros(len(words), np.int64)) == brute(words)
        want += [(a + len(many), n, p) for a, n, p in brute(words)]
        many += words
        pieces += [k] * len(words)
    assert runs_of(np.array(many, np.int64), np.array(pieces, np.int64)) == want
    assert runs_of(np.array(many[:900], np.int64), np.zeros(900, np.int64), 9, 5) == brute(many[:900], 9, 5)
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, np.int64), np.zeros(9, np.int64), 3, 2)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = [numbers[w] for w in words]
    runs = brute(ids) if len(ids) < 1500 else runs_of(np.array(ids, np.int64), np.zeros(len(ids), np.int64))
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    best = min(((-n, a, p) for a, n, p in runs), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op13_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(expected(*r) for r in rows)


def test_odd_texts(spark, tmp_path):
    texts = [None, "", " \n ", "a", "  a b\ta b a b a\x0bb a b ", "x " * 20_000, "ja " * 6, "ja " * 5, "é é " * 7, "line of words\n" * 4, ("a b c d\n" * 9 + "z ") * 5, " ".join(map(str, range(3000)))]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] * 2 + [(None, "y " * 9, None, None), (3_000_000, "one two", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, record string, runs int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((expected(i, t) for i, t, _, _ in rows), key=repr)
    assert sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == want
    whole = periodic_runs(df).where("record.doc_id = 4").first()
    assert whole["record"]["text"] == texts[4] and whole["n_words"] == 10 and whole["collapsed"] == "a b" and [tuple(r) for r in whole["runs"]] == [(0, 10, 2)]
    assert periodic_runs(df.limit(0)).count() == 0


def test_long_powers_take_little(spark):
    import time
    import tracemalloc

    tracemalloc.start()
    begun = time.time()
    assert runs_of(np.zeros(300_000, np.int64), np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert tracemalloc.get_traced_memory()[1] < 300e6 and time.time() - begun < 60
    tracemalloc.stop()
