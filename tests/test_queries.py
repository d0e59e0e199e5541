"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from evidarium.plans.load_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_all_have_sql():
    assert set(ORACLES) == set(QUERIES)


#: Rows that show nothing by themselves, others of the same operator showing every branch; the last two have rows
#: on larger tables than these.
EMPTY = {"q14_image_library_collapsed", "m19_link_history", "q20_typed_search", "x1_position_evidence"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect())
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in cur.fetchall())
    assert got == want
    assert got or name in EMPTY


def test_tables_exist(sf):
    assert all(os.path.exists(f"{sf}/{t}.parquet") for t in TABLES)


def test_connections_over_all_placements(spark, sf):
    import __spark_entry__

    some, all_, entry = (df.count() for df in (QUERIES["q9_connections"](spark, sf), QUERIES["q9_connections_all"](spark, sf), __spark_entry__.entry(spark)))
    assert some == all_ == entry


def test_similar_sets_and_their_members_are_all_pairs_of_parts(spark, sf):
    from evidarium.operators.matching import token_similarity

    names = {r[0]: set(r[1].lower().split()) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect()}
    want = {(i, j): len(a & b) / len(a | b) for i, a in names.items() for j, b in names.items() if 2 * len(a & b) >= len(a | b)}
    members = {}
    for r in QUERIES["x8_word_sets"](spark, sf).collect():
        members.setdefault(r["words"], []).append(r["id"])
    pairs = QUERIES["x8_similar_sets"](spark, sf).collect()
    assert len(pairs) == len({(r[0], r[1]) for r in pairs})
    assert {(i, j): r["similarity"] for r in pairs for i in members[r["left_words"]] for j in members[r["right_words"]]} == want
    parts = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", "p_name AS name")
    assert len(token_similarity(parts, parts).collect()) == len(want)


@pytest.mark.parametrize("at_least", [0.01, 0.34, 0.5, 0.75, 1.0])
def test_similar_sets_of_random_names(spark, at_least):
    import random

    from evidarium.operators.matching import token_similarity

    rng = random.Random(5)
    names = [(i, " ".join(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randrange(0, 7)))) for i in range(60)] + [(60, None)]
    sets = {i: set(n.split()) for i, n in names if n}
    left, right = (spark.createDataFrame(x, "id long, name string") for x in (names[:35], names[25:]))
    got = sorted(map(tuple, token_similarity(left, right, at_least).collect()))
    want = sorted((i, j, len(a & b) / len(a | b)) for i, a in sets.items() if i < 35 for j, b in sets.items() if j >= 25 and a & b and len(a & b) >= at_least * len(a | b))
    assert got == want


def test_paths_of_a_deep_hierarchy(spark):
    from types import SimpleNamespace

    from evidarium.plans.catalog import source_paths

    deep = spark.createDataFrame([(i, i - 1 if i else None, f"s{i}") for i in range(40)], "id long, parent_source_id long, source_code string")
    got = source_paths(SimpleNamespace(spark=spark, sources=deep)).collect()
    assert {r["id"]: (r["depth"], r["path"]) for r in got} == {i: (i, "/".join(f"s{k}" for k in range(i + 1))) for i in range(40)}


def test_listings_are_in_order(spark, sf):
    from evidarium.plans import catalog as q
    from evidarium.plans.analog import Catalog

    c = Catalog(spark, sf)
    for listing, key in (
        (q.parts(c), lambda r: (r["brand"], r["kit_name"], r["part_number"], r["id"])), (q.connections(c), lambda r: (-r["model_count"], r["brand"], r["name"])), (q.models(c), lambda r: (r["film"], r["name"])),
        (q.claims(c), lambda r: -r["id"]), (q.regions(c), lambda r: (r["image_id"], r["id"])), (q.image_library(c), lambda r: -r["id"]), (q.families(c), lambda r: -r["family_id"]), (q.contributors(c), lambda r: r["handle"]),
    ):
        rows = [key(r) for r in listing.collect()]
        assert rows and rows == sorted(rows)
