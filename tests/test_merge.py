from datetime import datetime

from pyspark.sql import functions as F

from evidarium.operators import merge, windows

POSITIONS = "id long, placement_id long, map_id long, position_type string, status string, is_current int, supersedes_id long, created_at timestamp"


def at(day):
    return datetime(2026, 1, day)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_promotion_and_restored_position(spark):
    table = spark.createDataFrame([(1, 1, 1, "box", "active", 1, None, at(1)), (2, 1, 1, "point", "active", 0, None, at(2)), (3, 2, 1, "box", "active", 1, None, at(1))], POSITIONS)
    promoted = merge.set_current(table, spark.createDataFrame([(1, 1), (2, 2)], "id long, change_seq int"))
    assert rows(promoted.where("is_current = 1"), "placement_id", "id") == [(1, 2), (2, 3)]
    gone = spark.createDataFrame([(2,)], "id long")
    assert rows(windows.replacement_positions(promoted, gone), "placement_id", "id") == [(1, 1)]


def test_at_most_one_current_and_ties(spark):
    table = spark.createDataFrame([(i, i % 3, 1, "box", "active", 1, None, at(1)) for i in range(1, 10)], POSITIONS)
    assert rows(windows.current_positions(table), "placement_id", "id") == [(0, 9), (1, 7), (2, 8)]


def test_supersede_chain(spark):
    table = spark.createDataFrame([(1, 1, 1, "box", "active", 1, None, at(1)), (2, 1, 1, "box", "active", 1, 1, at(2)), (3, 1, 1, "box", "active", 1, 2, at(3))], POSITIONS)
    assert rows(merge.supersede(table), "id", "status", "is_current") == [(1, "superseded", 0), (2, "superseded", 0), (3, "active", 1)]


def test_upserts_are_idempotent(spark):
    table = spark.createDataFrame([(1, "a", "n1"), (2, "", None)], "id long, name string, notes string")
    new = spark.createDataFrame([(2, "b", "n2"), (3, "c", None), (1, "z", "n1\nn3")], "id long, name string, notes string")
    for mode, want in (("replace", [(1, "z", "n1\nn3"), (2, "b", "n2"), (3, "c", None)]), ("fill", [(1, "a", "n1\nn3"), (2, "b", "n2"), (3, "c", None)])):
        once = merge.upsert(table, new, ["id"], mode).drop("merge_status")
        assert rows(once, "id", "name", "notes") == want
        assert rows(merge.upsert(once, new, ["id"], mode), "id", "name", "notes") == want


def test_insert_absent_with_null_keys_and_ids(spark):
    table = spark.createDataFrame([(7, "b", None)], "id long, brand string, serial string")
    new = spark.createDataFrame([("b", None), ("b", "1"), ("b", "1"), (None, None)], "brand string, serial string")
    fresh = merge.insert_absent(table, new, ["brand", "serial"])
    assert rows(fresh, "brand", "serial") == [("b", "1"), (None, None)]
    assert [r[0] for r in rows(merge.with_ids(table, fresh, ["brand", "serial"]), "id")] == [8, 9]


def test_partial_update_sets_null_and_keeps_the_rest(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n int")
    changes = spark.createDataFrame([(1, 1, {"name": "x", "n": "7"}), (1, 2, {"name": None})], "id long, change_seq int, fields map<string,string>")
    assert rows(merge.partial_update(table, changes, ["name", "n"]), "id", "name", "n") == [(1, None, 7), (2, "b", 6)]


def test_history(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "id long, v string")
    got = rows(merge.changed_rows(a, b, ["v"]), "id", "change", "prev_values", "new_values")
    assert got == [(2, "update", "{}", '{"v":"y"}'), (3, "delete", '{"v":"z"}', None), (4, "create", None, '{"v":"w"}')]


def test_rejects(spark):
    df = spark.createDataFrame([(1, "", "box", 1, None), (2, "n", "line", None, None), (3, "n", "point", 4, 9), (4, "n", None, None, 1)], "id long, name string, kind string, part_id long, kit_id long")
    other = spark.createDataFrame([(1,)], "id long")
    got = rows(merge.rejects(df, required=["name"], enums={"kind": ("box", "point")}, one_of=["part_id", "kit_id"], unique=["name"], foreign={"kit_id": other}), "key", "rule")
    assert got == sorted([(1, "required:name"), (2, "enum:kind"), (2, "one_of:part_id+kit_id"), (3, "one_of:part_id+kit_id"), *((k, "unique:name") for k in (2, 3, 4)), (3, "foreign:kit_id")], key=repr)


def test_family_conflicts_primary_and_absorb(spark):
    members = spark.createDataFrame([(1, 1, 10, 1, "primary"), (2, 1, 11, 0, "variant")], "id long, family_id long, image_id long, is_primary int, relation_type string")
    assert rows(merge.family_conflicts(members, spark.createDataFrame([(2, 10), (1, 11)], "family_id long, image_id long")), "image_id", "family_id", "held_by") == [(10, 2, 1)]
    flipped = merge.set_primary(members, spark.createDataFrame([(1, 11)], "family_id long, image_id long"))
    assert rows(flipped, "image_id", "is_primary", "relation_type") == [(10, 0, "variant"), (11, 1, "primary")]
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, notes string")
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "id long, survivor long")
    kept, gone = merge.absorb(images, pairs, spark.createDataFrame([(3,)], "id long"))
    assert rows(kept, "id", "notes") == [(1, "a\nb"), (3, "a")] and rows(gone, "id") == [(2,)]


def test_refresh_and_replace(spark):
    old = spark.createDataFrame([(1, "deck", 0.5), (2, "hand", 0.25)], "id long, tag string, x double")
    new = spark.createDataFrame([(5, "deck", 0.25), (6, "deck", 0.75)], "id long, tag string, x double")
    assert rows(merge.refresh(old, new, F.col("tag") == "deck", ["x"]), "id") == [(2,), (6,)]
    assert rows(merge.replace_rows(old, spark.createDataFrame([(2, "new", 1.0), (9, "no", 1.0)], "id long, tag string, x double")), "id", "tag") == [(1, "deck"), (2, "new")]


def test_upsert_of_repeated_and_null_keys(spark):
    table = spark.createDataFrame([(1, "a", ["p"]), (2, "b", None), (None, "c", ["q"])], "id long, name string, tags array<string>")
    new = spark.createDataFrame([(1, "x", ["r"], 1), (1, "y", ["p"], 2), (3, "z", None, 1), (3, "w", None, 1), (None, "n", ["q", "s"], 1)], "id long, name string, tags array<string>, seq int")
    out = merge.upsert(table, new, ["id"], sequence="seq")
    assert rows(out, "id", "name", "merge_status") == sorted([(1, "y", "updated"), (2, "b", "kept"), (3, "z", "inserted"), (None, "n", "updated")], key=repr)
    assert tuple(merge.merge_counts(out, new, ["id"]).first()) == (1, 2, 1, 2)
    filled = merge.upsert(table, new, ["id"], mode="fill", sequence="seq")
    assert rows(filled, "id", "name", "tags") == sorted([(1, "a", ["p"]), (2, "b", None), (3, "z", None), (None, "c", ["q", "s"])], key=repr)


def test_replaced_rows_and_ties_of_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, v string")
    assert rows(merge.replace_rows(table, new), "id", "v") == [(1, "y"), (2, "b")]
    changes = spark.createDataFrame([(1, 5, {"v": "p"}), (1, 5, {"v": "q"}), (1, 5, {"v": None}), (2, None, {"v": "r"})], "id long, change_seq int, fields map<string,string>")
    assert rows(merge.partial_update(table, changes, ["v"]), "id", "v") == [(1, "q"), (2, "r")]


FAMILY = "id long, family_id long, image_id long, is_primary int, is_hidden int, sort_order long, relation_type string"


def test_primaries_of_members_only(spark):
    members = spark.createDataFrame([(1, 1, 10, 1, 0, 0, "primary"), (2, 1, 11, 0, 0, 0, "variant"), (3, 2, 20, 1, 0, 0, "primary"), (4, 2, 21, 0, 0, 0, "crop")], FAMILY)
    chosen = spark.createDataFrame([(1, 99, 9), (1, 11, 1), (1, 10, 2), (2, 21, 1), (2, 21, 3), (7, 10, 1)], "family_id long, image_id long, change_seq int")
    out = merge.set_primary(members, chosen)
    assert rows(out, "id", "is_primary", "relation_type") == [(1, 1, "primary"), (2, 0, "variant"), (3, 0, "variant"), (4, 1, "primary")]
    assert rows(merge.primary_rejects(members, chosen), "family_id", "image_id", "held_by") == [(1, 99, None), (7, 10, 1)]


def test_members_come_go_and_move(spark):
    members = spark.createDataFrame([(1, 1, 10, 1, 0, 0, "primary"), (2, 1, 11, 0, 0, 2, "variant"), (3, 1, 12, 0, 0, 1, "variant"), (4, 2, 20, 1, 0, 0, "primary")], FAMILY)
    new = spark.createDataFrame([(2, 30, 1), (2, 31, 0), (2, 31, 0), (2, 10, 0), (1, 11, 0), (1, 40, 0), (2, 40, 0)], "family_id long, image_id long, is_primary int")
    out, conflicts = merge.attach_members(members, new)
    assert rows(conflicts, "family_id", "image_id") == [(1, 40), (2, 10), (2, 40)]
    assert rows(out.where("family_id = 2"), "image_id", "is_primary", "relation_type") == [(20, 0, "variant"), (30, 1, "primary"), (31, 0, "variant")]
    assert {r["id"] for r in out.collect()} == {1, 2, 3, 4, 5, 6}
    left = merge.detach_members(members, spark.createDataFrame([(10,), (20,)], "image_id long"))
    assert rows(left, "image_id", "is_primary", "relation_type") == [(11, 0, "variant"), (12, 1, "primary")]
    moved = merge.move_members(members, spark.createDataFrame([(10, 2), (20, 2)], "image_id long, family_id long"))
    assert rows(moved, "family_id", "image_id", "is_primary") == [(1, 11, 0), (1, 12, 1), (2, 10, 0), (2, 20, 1)]


def test_chains_of_superseded_positions(spark):
    table = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 77), (5, 6), (6, 5)], "id long, supersedes_id long")
    assert rows(merge.supersede_depths(table), "id", "depth", "first_id") == [(1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 0, 4)]


def test_absorbed_tags(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, notes string")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (1, 1)], "id long, survivor long")
    tags = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (3, "z")], "image_id long, tag string")
    kept, gone, left = merge.absorb(images, pairs, spark.createDataFrame([(3,)], "id long"), tags)
    assert rows(kept, "id", "notes") == [(1, "a\nb\nc"), (3, "c")] and rows(gone, "id") == [(2,)]
    assert rows(left, "image_id", "tag") == [(1, "x"), (1, "y"), (1, "z"), (3, "x"), (3, "z")]


def test_child_sets_may_be_emptied(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "image_id long, tag string")
    new = spark.createDataFrame([(1, "z"), (1, "z")], "image_id long, tag string")
    assert rows(merge.replace_children(tags, "image_id", new), "image_id", "tag") == [(1, "z"), (2, "c"), (3, "d")]
    assert rows(merge.replace_children(tags, "image_id", new, spark.createDataFrame([(2,)], "image_id long")), "image_id", "tag") == [(1, "z"), (3, "d")]


def test_positions_on_maps_of_other_models(spark):
    positions = spark.createDataFrame([(1, 10, 5), (2, 10, 6), (3, 10, None)], "id long, placement_id long, map_id long")
    placements, maps = spark.createDataFrame([(10, 1)], "id long, model_id long"), spark.createDataFrame([(5, 1), (6, 2)], "id long, model_id long")
    assert rows(merge.map_rejects(positions, placements, maps), "key", "rule") == [(2, "map_of_model")]


def test_counts_are_observed_while_rows_are_written(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, name string")
    incoming = spark.createDataFrame([(2, "b"), (2, "bb"), (4, "d"), (4, "d"), (None, "n")], "id long, name string")
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    watched = incoming.coalesce(1).mapInArrow(seen, incoming.schema)
    got, counts = merge.written_upsert(table, watched, ["id"], f"{tmp_path}/new")
    assert reads.value == 5  # read once
    want = merge.upsert(table, incoming, ["id"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert counts == merge.merge_counts(want, incoming, ["id"]).first().asDict() == {"inserted": 2, "updated": 1, "kept": 2, "skipped": 2}
    again, counts = merge.written_upsert(table.limit(0), incoming.limit(0), ["id"], f"{tmp_path}/none")
    assert again.count() == 0 and counts == {"inserted": 0, "updated": 0, "kept": 0, "skipped": 0}


def test_counters_take_one_pass(spark):
    from evidarium.operators.counters import counters

    df = spark.createDataFrame([("a", 1, None), ("a", 2, ""), (None, 1, "x")], "k string, n int, e string")
    out = counters(df, {"kind": F.col("k"), "number": F.col("n"), "again": F.col("k"), "all": F.lit(""), "e": F.col("e")})
    assert rows(out, "section", "key", "count") == sorted([("kind", "a", 2), ("kind", "", 1), ("number", "1", 2), ("number", "2", 1), ("again", "a", 2), ("again", "", 1), ("all", "", 3), ("e", "", 2), ("e", "x", 1)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "Generate" not in plan
    assert rows(counters(df, {"one": F.col("n")}, top=1), "section", "key", "count") == [("one", "1", 2)]


def test_absorbed_by_key_is_absorbed_by_pairs(spark):
    notes = {1: "own\np=a", 2: "z\nown\np=a", 3: " b \n\nz\np=a", 4: None, 5: "c\np=b", 6: "a\np=b", 7: "alone", 8: "c"}
    images = spark.createDataFrame(list(notes.items()), "id long, notes string")
    duplicates = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b"), (6, "b"), (8, "c")], "id long, path string")
    survivors = spark.createDataFrame([(1, "a"), (7, "a"), (7, "b"), (5, "b"), (8, "c"), (7, "none")], "id long, path string")
    tags = spark.createDataFrame([(2, "two"), (3, "two"), (6, "six"), (8, "eight"), (7, "own")], "image_id long, tag string")
    used = spark.createDataFrame([(3,), (1,), (5,), (7,)], "id long")
    pairs = duplicates.join(survivors.withColumnRenamed("id", "survivor"), "path").select("id", "survivor")
    kept, gone, left = merge.absorb(images, pairs, used, tags)
    got = merge.absorbed_ids(duplicates, survivors, "path", used)
    assert sorted(got.collect()) == sorted(gone.collect()) == [(2,), (4,), (6,)]
    assert sorted(merge.absorbed_notes(images, duplicates, survivors, "path").join(got, "id", "left_anti").collect()) == sorted(kept.collect())
    all_tags = merge.absorbed_tags(tags, duplicates, survivors, "path")
    assert sorted(all_tags.join(got.withColumnRenamed("id", "image_id"), "image_id", "left_anti").collect()) == sorted(left.collect())


def test_zero_of_every_kind_is_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.0D, 0, ' 0 ', 0.00BD), (2, -0.0D, 1, 'x', 1.00BD), (3, 0.5D, NULL, '', NULL), (4, double('NaN'), 2, '00', 2.5BD) AS t (id, a, b, c, d)")
    got = rows(merge.rejects(df, required=["a", "b", "c", "d"]), "key", "rule")
    assert got == sorted([(1, "required:a"), (1, "required:b"), (1, "required:c"), (1, "required:d"), (2, "required:a"), (3, "required:b"), (3, "required:c"), (3, "required:d")])
