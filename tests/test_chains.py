import random

from evidarium.operators.chains import chains, cycles
from evidarium.operators.merge import supersede_cycles, supersede_depths


def brute(parent):
    out = {}
    for i in parent:
        seen, at = [], i
        while at not in seen and parent.get(at) in parent and parent[at] is not None:
            seen.append(at)
            at = parent[at]
        if at in seen:
            ring = seen[seen.index(at) :]
            out[i] = (None, None, min(ring), i in ring, False)
        else:
            out[i] = (at, len(seen), None, False, parent[at] is not None)
    return out


def test_random_forests_and_cycles(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 60, 300):
        parent = {i: rng.choice([None, rng.randrange(n), rng.randrange(n), i - 1 if i else None, n + 5]) for i in range(n)}
        rows = spark.createDataFrame([(i, p, f"n{i}", 1) for i, p in parent.items()], "id long, before long, label string, depth int")
        got = {r["id"]: r for r in chains(rows, "id", "before", "label").collect()}
        want = brute(parent)
        assert {i: (r["root"], r["depth"], r["cycle"], r["on_cycle"], r["dangling"]) for i, r in got.items()} == want
        for i, (root, depth, *_) in want.items():
            path, at = [], i
            while root is not None and len(path) <= depth:
                path.insert(0, f"n{at}")
                at = parent[at]
            assert got[i]["path"] == ("/".join(path) if root is not None else None)


def test_a_chain_of_five_thousand_and_a_cycle(spark):
    rows = [(i, i - 1 if i else None) for i in range(5000)] + [(10_000 + i, 10_000 + (i + 1) % 700) for i in range(700)] + [(20_000, 10_003), (20_001, 20_000)]
    df = spark.createDataFrame(rows, "id long, supersedes_id long").repartition(4)
    depths = {r["id"]: (r["depth"], r["first_id"]) for r in supersede_depths(df).collect()}
    assert depths == {i: (i, 0) for i in range(5000)}
    assert [tuple(r) for r in supersede_cycles(df).collect()] == [(10_000, 700, 2)]


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, "x"), (2, 1, None), (2, 3, "b"), (3, 3, "self"), (None, 1, "y"), (4, 99, "d"), (5, 4, "e")]
    found = chains(spark.createDataFrame(rows, "id long, before long, label string"), "id", "before", "label")
    assert {tuple(r) for r in found.collect()} == {(1, 1, 0, None, False, False, ""), (2, 1, 1, None, False, False, "/"), (3, None, None, 3, True, False, None), (4, 4, 0, None, False, True, "d"), (5, 4, 1, None, False, True, "d/e")}
    assert [tuple(r) for r in cycles(found).collect()] == [(3, 1, 0)]
    assert chains(spark.createDataFrame([], "id long, before long"), "id", "before").count() == 0


def test_chains_that_pass_through_many_pieces(spark, monkeypatch):
    from evidarium.operators import chains as module

    rng = random.Random(2)
    for n, size in ((1, 1), (40, 1), (90, 7), (400, 30)):
        monkeypatch.setattr(module, "PIECE", size)
        near = {i: rng.choice([i - 1, i - 2, i - 3, i + 1] + [None, rng.randrange(n), n + 5] * (i % 20 == 0)) for i in range(n)}
        for parent in (near, {i: rng.randrange(n) for i in range(n)}, {i: (i * 7 + 3) % n for i in range(n)}, {i: i ^ 1 for i in range(n)}):
            rows = spark.createDataFrame(list(parent.items()), "id long, before long")
            got = {r["id"]: (r["root"], r["depth"], r["cycle"], r["on_cycle"], r["dangling"]) for r in chains(rows, "id", "before").collect()}
            assert got == brute(parent)


def test_rows_that_name_rows_near_by_are_followed_in_their_piece(spark, monkeypatch):
    from evidarium.operators import chains as module

    written, held = {}, module.kept

    def counted(df, name):
        out = held(df, name)
        written[name] = [*written.get(name, []), out.count()]
        return out

    monkeypatch.setattr(module, "kept", counted)
    assert chains(spark.range(20_000).selectExpr("id", "CASE WHEN id > 2 THEN id - 3 END AS before"), "id", "before").where("depth = id DIV 3 AND root = id % 3").count() == 20_000
    # Before, all rows were written once for each doubling.
    assert sum(map(sum, written.values())) < 21_000
