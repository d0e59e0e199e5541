import random
import re

from pyspark.sql import functions as F

from evidarium.llm.pii import BASE, personal_data, reliabilities

SCHEMA = "doc_id long, text string, spans string, kind int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.ASCII) if passes(k, m[0])]


TEXTS = [
    None, "", "mail a.b@c-d.example, x@y @z.w a@b.c_d@e.f a@b..c", "é ip 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.4 0.0.0.0", "card 4111 1111 1111 1111 4111111111111112 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 12  4111111111111111",
    "+49 (30) 123-456 +1 +1 2 +123456789012345678 +44 20 7946 0958.", "日本 a@b.co 日本 +4915112345678", "a" * 100_000 + " b@c.d", "a@" + "b." * 20_000 + "c", "1." * 30_000, "1 " * 20_000, "+1" + " (" * 20_000,
    "x\x01y@z.com\x01 1.1.1.1", "write to jane [at] mail [dot] example please", "call 555-123-4567 or (212) 555-0199 phone", "ssn 123-45-6789", "0000000000000 00000000000000000000", "1234567890123-4 5-6",
]


def fuzz(n):
    rng = random.Random(8)
    parts = ["@", ".", "-", " ", "+", "(", ")", "a", "b9", "_", "%", "1", "25", "255", "4111", "1111", "00", "é", "\n", "com"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_base_spans_against_regexes(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS + fuzz(1500))] + [(None, "a@b.co", "x", 1), (2, "a@b.co", "x", 1)]
    out = personal_data(spark.createDataFrame(rows, SCHEMA)).select("record.doc_id", "record.text", "spans").collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute(r["text"]), r["text"]
        spans = [s for s in r["spans"] if not s["base"]]
        for s in spans:
            assert all(s["end"] <= b["start"] or b["end"] <= s["start"] for b in r["spans"] if b["base"])
    added = {r["text"][s["start"] : s["end"]] for r in out for s in r["spans"] if not s["base"]}
    assert "jane [at] mail [dot] example" in added


def test_reliabilities_recover_planted_labelers():
    rng = random.Random(1)
    accuracy, counts = (0.95, 0.9, 0.7, 0.6), {}
    for _ in range(20_000):
        y = 1 if rng.random() < 0.6 else -1
        v = tuple(0 if rng.random() < 0.2 else y if rng.random() < a else -y for a in accuracy)
        counts[v] = counts.get(v, 0) + 1
    _, found = reliabilities([(0, v, n) for v, n in counts.items()])
    assert all(abs(found[0, j] - a) < 0.05 for j, a in enumerate(accuracy))


def test_tables_without_candidates(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    assert personal_data(spark.createDataFrame([(1, "plain words", "x", 1)], SCHEMA)).collect()[0]["spans"] == []
    assert len(BASE) == 4


def test_ends_of_many_parts(spark):
    from evidarium.llm.pii import ends_of

    rng = random.Random(7)
    rows = [(["x" * rng.randrange(4) for _ in range(n)],) for n in (1, 2, 63, 64, 65, 128, 129, 5000)]
    for r in spark.createDataFrame(rows, "p array<string>").select("p", ends_of(F.col("p")).alias("e")).collect():
        want = [0]
        for part in r["p"]:
            want.append(want[-1] + len(part))
        assert r["e"] == want


def test_many_matches_in_one_text(spark, monkeypatch):
    import time

    import evidarium.llm.pii as op

    rng = random.Random(11)
    parts = ["call +49 30 1234567 now", "tel 030 123 4567", "a{0}@b.org", "a{0} [at] b.org", "10.0.{0}.7", "4111 1111 1111 1111", "ssn 123-45-6789", "no data here", "+1 (212) 555 01{0}"]
    texts = [" ".join(rng.choice(parts).format(rng.randrange(250)) for _ in range(n)) for n in (1, 9, 40, 300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    shown = lambda: [[tuple(s) for s in r["spans"]] for r in op.personal_data(docs).orderBy("record.doc_id").collect()]
    halves = shown()
    monkeypatch.setattr(op, "FEW", 10_000)
    assert shown() == halves and any(not s[3] for s in halves[-1])
    monkeypatch.undo()
    long = " ".join(rng.choice(parts).format(rng.randrange(250)) for _ in range(100_000))
    begun = time.time()
    found = op.personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).select(F.size("spans")).first()[0]
    assert found > 50_000
    print("seconds", time.time() - begun)
    assert time.time() - begun < 100
