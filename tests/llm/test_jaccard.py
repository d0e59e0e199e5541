import random
import re

import pytest

import evidarium.llm.jaccard as jaccard
from evidarium.llm.graph import components
from evidarium.llm.jaccard import near_duplicates

SCHEMA = "doc_id long, text string, n string, key int"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    out = []
    for i, (d, x) in enumerate(sets):
        same = [sets[j][0] for j in range(len(sets)) if find(j) == find(i) and sets[j][0] is not None]
        out.append((d, len(x), min(same, default=None)))
    return sorted(out, key=repr)


def ours(spark, rows):
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = [r for r in out if r["kept"]]
    assert all(r["id"] == r["component_id"] for r in kept)
    if len({r["id"] for r in out}) == len(out):
        assert len(kept) == len({r["component_id"] for r in out})
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in out), key=repr)


def corpus(seed, n, words):
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(words)}" for _ in range(k)]
    passage, out = text(30), []
    for base in range(n):
        body = text(rng.choice([3, 6, 20, 60, 120]))
        if rng.random() < 0.3:
            body += passage
        out.append(body)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(body)
            for _ in range(rng.randrange(1 + len(body) // 25)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = text(1)
            out.append(copy)
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return [(i, (" " if i % 2 else "\n").join(t).upper() if i % 3 else " ".join(t), "x", 1) for i, t in zip(ids, out)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 3000)
    for seed, words, often in ((1, 4000, 64), (2, 6, 64), (3, 4000, 100_000)):
        monkeypatch.setattr(jaccard, "OFTEN", often)
        rows = corpus(seed, 60, words)
        rows += [(1000, None, "x", 1), (1001, "", "x", 1), (1002, " \n", "x", 1), (1003, "one two", "x", 1), (1004, "ONE  two", "x", 1), (1005, "one two three", "x", 1), (None, rows[0][1], "x", 1), (None, None, "x", 1), (3, rows[5][1], "x", 1), (2000, "a b c d e " * 9000, "x", 1)]
        assert ours(spark, rows) == brute(rows)


def test_frequent_shingles_are_found(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 2000)
    docs = spark.createDataFrame([(i, f"own{i} a b c d e own{i}", "x", 1) for i in range(200)], SCHEMA)
    members, _ = jaccard.similar_classes(docs)
    want = set(jaccard.shingle_set(b"a b c d e").tolist())
    assert set(jaccard.frequent_shingles(members).tolist()) == want


@pytest.mark.parametrize("hubs", [0, 2])
def test_one_large_group_of_near_copies(spark, monkeypatch, hubs):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "HUB_ROWS", 7)
    monkeypatch.setattr(jaccard, "MORE_HUBS", hubs)
    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(60)], []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            copy[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 7, " ".join(copy), "x", 1))
    rows += [(i + 500, " ".join([*base[:25], *(f"y{i}-{k}" for k in range(40))]), "x", 1) for i in range(40)]  # a passage many share
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed, hubs", [(1, 0), (2, 2), (3, 0)])
def test_large_groups_with_differences_in_common(spark, monkeypatch, seed, hubs):
    """Copies by a few shared edits: cuts, doubled words, swaps with one of two words, and other openings or ends."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "MORE_HUBS", hubs)
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(80)], []
    ends = [[f"{c}{i}" for i in range(30)] for c in "pqr"]
    for i in range(260):
        copy = base[: rng.choice([40, 55, 60, 70, 80, 80, 80])] + rng.choice([[], [], [], ends[0], ends[1], ends[2][: rng.randrange(30)]])
        copy = copy[rng.choice([0, 0, 0, 5, 12]) :]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = 4 * rng.randrange(len(copy) // 4)
            kind = rng.randrange(3)
            copy[at : at + 1] = [] if kind == 0 else [copy[at]] * 2 if kind == 1 else [rng.choice("uv")]
        rows.append((i + 3, " ".join(copy), "x", 1))
    want = brute(rows)
    assert len({c for *_, c in want}) > 3
    assert ours(spark, rows) == want


def test_components_of_blocks_and_long_chains(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(90)] + [(200 + i, 200) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    for block in (500, 40):
        assert {tuple(r) for r in components(frame, block).collect()} == set(root.items())


@pytest.mark.parametrize("edge", [(20, 3), (20, 4), (60, 12)])
def test_similarity_at_the_threshold(spark, edge):
    n, changed = edge
    a = [f"w{i}" for i in range(n)]
    rows = [(k, " ".join(a[: n - k]), "x", 1) for k in range(changed + 4)]
    assert ours(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []
