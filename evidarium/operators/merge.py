"""Batches of change records against a table: merges, partial updates, elections, history, validation, deletes.

Nothing here writes. Each function returns the new snapshot or the rows for a log; the caller writes a new directory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import blank_to_null, fill, note_union
from .chains import chains, cycles
from .pages import numbered_within
from .windows import first_per


def same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def insert_absent(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key (nulls equal) the table lacks, each key once."""
    fresh = first_per(incoming, keys, [F.hash(*incoming.columns), F.to_json(F.struct("*"))])
    return fresh.alias("n").join(table.select(*keys).alias("t"), same("n", "t", keys), "left_anti")


def with_ids(table: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """Fresh rows get the ids after the table's largest, in the given order, nulls first. Rows are numbered by ranges, so no
    task numbers all."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("_top"))  # one row
    numbered = numbered_within(fresh.drop("id"), [], [F.asc(c) for c in order], "_number")
    return numbered.crossJoin(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_number")).cast("long")).drop("_top", "_number")


def last_per(rows: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Of rows with one key (nulls equal) the last by sequence; ties, and rows without a sequence, go by all their values,
    so that the same rows always give the same one."""
    order = [F.desc_nulls_last(sequence)] if sequence else []
    return first_per(rows, keys, [*order, F.desc(F.to_json(F.struct(*rows.columns)))])


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], mode: str = "replace", sequence: str | None = None) -> DataFrame:
    """The table with incoming merged on keys, null keys being equal. replace: incoming values win where they are not null;
    fill: they only fill what is null or blank, and notes and tags are united. Of several incoming rows for one key the
    last by `sequence`, a column of incoming, counts. merge_status: inserted, updated or kept; see merge_counts."""
    left = table.withColumn("_held", F.lit(True)).alias("t")
    right = last_per(incoming, keys, sequence).withColumn("_came", F.lit(True)).alias("n")
    both = left.join(right, same("t", "n", keys), "full")
    kinds = dict(table.dtypes)

    def merged(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"n.{c}") if c in incoming.columns else F.lit(None)
        if mode == "replace":
            return F.coalesce(new, old)
        if kinds[c] == "array<string>":
            return F.when(old.isNotNull() | new.isNotNull(), F.array_distinct(F.concat(F.coalesce(old, F.array().cast(kinds[c])), F.coalesce(new, F.array().cast(kinds[c])))))
        if c == "notes":
            return note_union(old, new)
        return fill(old, new) if kinds[c] == "string" else F.coalesce(old, new)

    picked = [F.coalesce(F.col(f"t.{c}"), F.col(f"n.{c}")).alias(c) if c in keys else merged(c).alias(c) for c in table.columns]
    status = F.when(F.col("t._held").isNull(), "inserted").when(F.col("n._came").isNotNull(), "updated").otherwise("kept")
    return both.select(*picked, status.alias("merge_status"))


def merge_counts(merged: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row: inserted, updated and kept rows of an upsert, and skipped: incoming rows that lost to another with their key."""
    came = incoming.select(F.count(F.lit(1)).alias("came"), F.count_distinct(F.struct(*keys)).alias("once"))
    done = merged.agg(*[F.count_if(F.col("merge_status") == s).alias(s) for s in ("inserted", "updated", "kept")])
    return done.join(came).select("inserted", "updated", "kept", (F.col("came") - F.col("once")).alias("skipped"))


def observed(seen: Observation) -> dict[str, int]:
    """What was observed; nothing where Spark has left the observation out, as there can be no rows."""
    return seen.get if seen._jo.getRow().length() else {}


def written_upsert(table: DataFrame, incoming: DataFrame, keys: list[str], path: str, mode: str = "replace", sequence: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """upsert, written to a new path and read back, with the counts of merge_counts: they are observed while the rows are
    written, so neither side is read for them. What a lost executor has counted and must do again may be counted twice; the
    rows are not."""
    came, done = Observation("came"), Observation("done")
    counted = incoming.observe(came, F.count(F.lit(1)).alias("came"))
    merged = upsert(table, counted, keys, mode, sequence)
    merged.observe(done, *[F.count_if(F.col("merge_status") == s).alias(s) for s in ("inserted", "updated", "kept")]).write.parquet(path)
    found = {s: observed(done).get(s, 0) for s in ("inserted", "updated", "kept")}
    # Of the rows of one key, one is inserted or updates.
    found["skipped"] = observed(came).get("came", 0) - found["inserted"] - found["updated"]
    return table.sparkSession.read.schema(merged.schema).parquet(path), found


def partial_update(table: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """changes: id, change_seq, fields (map of set fields as text; a key with null sets null). Of several changes to one
    field the last counts, of those with one change_seq the greatest value, null being the least; a field that no change
    names keeps its value."""
    each = changes.select("id", "change_seq", F.explode("fields").alias("field", "value"))
    last = first_per(each, ["id", "field"], [F.desc_nulls_last("change_seq"), F.desc_nulls_last("value")])
    maps = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    kinds = dict(table.dtypes)
    new = lambda c: F.when(F.map_contains_key("fields", F.lit(c)), F.col("fields")[c].try_cast(kinds[c])).otherwise(F.col(c))
    return table.join(maps, "id", "left").select(*[(new(c) if c in columns else F.col(c)).alias(c) for c in table.columns])


def replace_rows(table: DataFrame, incoming: DataFrame, sequence: str | None = None) -> DataFrame:
    """Rows with the ids of incoming are replaced whole; of several for one id the last counts (see last_per). Ids that the
    table lacks, and null ones, replace nothing."""
    known = last_per(incoming, ["id"], sequence).join(table.select("id"), "id", "left_semi")
    return table.join(incoming.select("id"), "id", "left_anti").unionByName(known.select(*table.columns))


def changed_rows(before: DataFrame, after: DataFrame, watched: list[str], key: str = "id") -> DataFrame:
    """History: key, change, prev_values and new_values (JSON) of rows that are new, gone or differ in a watched column."""
    snap = lambda df, name: df.select(F.col(key), F.struct(*watched).alias(name))
    both = snap(before, "old").join(snap(after, "new"), key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select(key, kind.alias("change"), F.to_json("old").alias("prev_values"), F.to_json("new").alias("new_values"))


def set_current(positions: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: id, change_seq. Each becomes the current and active position of its placement and map, its siblings are no
    longer current; of several for one map the last counts."""
    picks = positions.select("id", "placement_id", "map_id").join(chosen, "id")
    last = first_per(picks, ["placement_id", "map_id"], [F.desc("change_seq"), F.desc("id")]).select("placement_id", "map_id", F.col("id").alias("pick"))
    out = positions.join(last, ["placement_id", "map_id"], "left")
    mine = F.col("id").eqNullSafe(F.col("pick"))
    return out.withColumns({"is_current": F.when(F.col("pick").isNull(), F.col("is_current")).otherwise(mine.cast("int")), "status": F.when(mine & F.col("pick").isNotNull(), "active").otherwise(F.col("status"))}).select(*positions.columns)


def supersede(positions: DataFrame) -> DataFrame:
    """Rows that another row supersedes get that status and are not current."""
    old = positions.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id")).distinct().withColumn("_over", F.lit(True))
    over = F.coalesce("_over", F.lit(False))
    return positions.join(old, "id", "left").withColumns({"status": F.when(over, "superseded").otherwise(F.col("status")), "is_current": F.when(over, 0).otherwise(F.col("is_current"))}).select(*positions.columns)


def supersede_depths(positions: DataFrame) -> DataFrame:
    """(id, depth, first_id): how many positions each one supersedes in a row, and the first of its chain; a position that
    supersedes a missing one is a first. A chain that goes round has no first and gives no row: supersede_cycles has it."""
    return chains(positions, "id", "supersedes_id").where("cycle is null").select("id", "depth", F.col("root").alias("first_id"))


def supersede_cycles(positions: DataFrame) -> DataFrame:
    """(cycle, rows, leading): positions that supersede each other in a circle, by the smallest id, and how many lead there."""
    return cycles(chains(positions, "id", "supersedes_id"))


def set_primary(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: family_id, image_id, and change_seq if there is one. The chosen member is primary; a former primary becomes a
    variant, a variant that is chosen becomes primary. Choices of images that are no members change nothing (see
    primary_rejects); of several for one family the last counts, without change_seq the highest image."""
    order = [F.desc_nulls_last("change_seq")] if "change_seq" in chosen.columns else []
    valid = chosen.join(members.select("family_id", "image_id"), ["family_id", "image_id"], "left_semi")
    picks = first_per(valid, ["family_id"], [*order, F.desc("image_id")]).select("family_id", F.col("image_id").alias("_pick"))
    out = members.join(picks, "family_id", "left")
    mine = F.col("image_id") == F.col("_pick")
    return out.withColumns({"is_primary": F.when(F.col("_pick").isNull(), F.col("is_primary")).otherwise(mine.cast("int")), "relation_type": F.when(mine, "primary").when(F.col("_pick").isNotNull() & (F.col("relation_type") == "primary"), "variant").otherwise(F.col("relation_type"))}).select(*members.columns)


def primary_rejects(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(family_id, image_id, held_by) of choices that name no member of the family; held_by is the family that has it."""
    wrong = chosen.select("family_id", "image_id").distinct().join(members.select("family_id", "image_id"), ["family_id", "image_id"], "left_anti")
    return wrong.join(members.groupBy("image_id").agg(F.min("family_id").alias("held_by")), "image_id", "left").select("family_id", "image_id", "held_by")


def attach_members(members: DataFrame, attached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """attached: family_id, image_id and any other member columns. New members with ids behind the largest; what asks to be
    primary (is_primary 1 or relation_type primary) is made so. An image stays in one family: a member of another is a
    conflict, and so is an image that would join several; one already there changes nothing. Returns members, conflicts."""
    conflicts = family_conflicts(members, attached).select("family_id", "image_id")
    torn = attached.groupBy("image_id").agg(F.count_distinct("family_id").alias("_n")).where("_n > 1").select("image_id")
    conflicts = conflicts.union(attached.join(torn, "image_id", "left_semi").select("family_id", "image_id")).distinct()
    free = attached.join(members.select("image_id"), "image_id", "left_anti").join(torn, "image_id", "left_anti")
    free = last_per(free, ["family_id", "image_id"])
    asked = F.coalesce(F.col("is_primary"), F.lit(0)) if "is_primary" in attached.columns else F.lit(0)
    kind = F.col("relation_type") if "relation_type" in attached.columns else F.lit(None).cast("string")
    free = free.withColumn("relation_type", F.coalesce(kind, F.when(asked == 1, "primary").otherwise("variant"))).withColumn("is_primary", ((asked == 1) | (F.col("relation_type") == "primary")).cast("int"))
    fresh = with_ids(members, free, ["family_id", "image_id"])
    known = dict(members.dtypes)
    blank = {c: F.lit(0) if c in ("sort_order", "is_hidden") else F.lit(None).cast(known[c]) for c in members.columns if c not in fresh.columns}
    fresh = fresh.withColumns(blank).select(*[F.col(c).cast(known[c]).alias(c) for c in members.columns])
    return set_primary(members.unionByName(fresh), fresh.where("is_primary = 1").select("family_id", "image_id")), conflicts


def detach_members(members: DataFrame, detached: DataFrame) -> DataFrame:
    """members without the images of detached (image_id). A family that loses its primary gets the first of those left, by
    sort_order and id."""
    gone = detached.select("image_id").distinct()
    bereft = members.join(gone, "image_id", "left_semi").where("is_primary = 1").select("family_id").distinct()
    left = members.join(gone, "image_id", "left_anti").select(*members.columns)
    heirs = first_per(left.join(bereft, "family_id", "left_semi"), ["family_id"], [F.desc_nulls_last("is_primary"), F.asc_nulls_first("sort_order"), F.asc("id")])
    return set_primary(left, heirs.select("family_id", "image_id"))


def move_members(members: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: image_id, family_id (the new one). Detached, then attached as variants; the last move of an image counts by
    the highest family. Images that are no members are attached too."""
    last = moves.groupBy("image_id").agg(F.max("family_id").alias("family_id"))
    stay = last.join(members.select("image_id", "family_id"), ["image_id", "family_id"], "left_anti").select("family_id", "image_id")
    return attach_members(detach_members(members, stay), stay)[0]


def family_conflicts(members: DataFrame, attached: DataFrame) -> DataFrame:
    """Images that would be in two families."""
    return attached.select("family_id", "image_id").join(members.select(F.col("family_id").alias("held_by"), "image_id"), "image_id").where("family_id <> held_by")


def rejects(table: DataFrame, required: list[str] = (), enums: dict[str, tuple[str, ...]] | None = None, one_of: list[str] = (), unique: list[str] = (), foreign: dict[str, DataFrame] | None = None, key: str = "id") -> DataFrame:
    """(key, rule) for each broken rule: required fields (blank and 0 count as missing), value lists, exactly one of
    several keys, uniqueness, and ids that must exist in another table."""
    numbers = {f.name for f in table.schema if isinstance(f.dataType, NumericType)}
    zero = lambda c: F.col(c) == F.lit(0) if c in numbers else blank_to_null(F.col(c)) == "0"  # noqa: E731  0.0 is 0 too
    rules: list[Column] = [F.when(F.coalesce(blank_to_null(F.col(c)).isNull() | zero(c), F.lit(True)), F.lit(f"required:{c}")) for c in required]
    rules += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(f"enum:{c}")) for c, values in (enums or {}).items()]
    if one_of:
        rules.append(F.when(reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in one_of]) != 1, F.lit("one_of:" + "+".join(one_of))))
    out = table.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*rules, F.lit(None).cast("string")))).alias("rule"))
    if unique:
        many = table.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.union(table.alias("t").join(many.alias("m"), same("t", "m", list(unique)), "left_semi").select(F.col(key), F.lit("unique:" + "+".join(unique))))
    for c, other in (foreign or {}).items():
        held = other.select(F.col("id").alias(c)).distinct()
        out = out.union(table.where(F.col(c).isNotNull()).join(held, c, "left_anti").select(F.col(key), F.lit(f"foreign:{c}")))
    return out


def map_rejects(positions: DataFrame, placements: DataFrame, maps: DataFrame) -> DataFrame:
    """(key, rule) of positions on a map of another model than their placement's."""
    own = placements.select(F.col("id").alias("placement_id"), F.col("model_id").alias("_model"))
    shown = maps.select(F.col("id").alias("map_id"), F.col("model_id").alias("_shown"))
    return positions.join(own, "placement_id").join(shown, "map_id").where("_model <> _shown").select(F.col("id").alias("key"), F.lit("map_of_model").alias("rule"))


def cascade(children: DataFrame, column: str, deleted: DataFrame, how: str = "cascade") -> DataFrame:
    """Children of deleted rows: gone (cascade), with the column null (set_null), or the rows that forbid it (blocked)."""
    ids = deleted.select(F.col("id").alias(column)).distinct()
    if how == "cascade":
        return children.join(ids, column, "left_anti").select(*children.columns)
    if how == "blocked":
        return children.join(ids, column, "left_semi").select(*children.columns)
    mark = ids.withColumn("_gone", F.lit(True))
    return children.join(mark, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*children.columns)


def replace_children(children: DataFrame, parent: str, incoming: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """All children of the parents that incoming names, or parents does, are replaced by the rows of incoming: a parent
    without any there has no children afterwards."""
    named = incoming.select(parent) if parents is None else incoming.select(parent).union(parents.select(parent))
    return children.join(named.distinct(), parent, "left_anti").unionByName(incoming.dropDuplicates(), allowMissingColumns=True)


def refresh(table: DataFrame, incoming: DataFrame, imported: Column, signature: list[str]) -> DataFrame:
    """Rows of an earlier import are dropped, incoming ones added unless one with the same signature is left."""
    left = table.where(~F.coalesce(imported, F.lit(False)))
    return left.unionByName(insert_absent(left, incoming, signature), allowMissingColumns=True)


def absorb(images: DataFrame, duplicates: DataFrame, used: DataFrame, tags: DataFrame | None = None) -> tuple:
    """duplicates: id, survivor. Notes go to the survivor; duplicates without use (ids in used) are dropped. Returns the
    images and the ids dropped, and with tags (image_id, tag) the tags, of which the survivor has all and the dropped none."""
    pairs = duplicates.where("id <> survivor").distinct()
    notes = images.join(pairs, "id").groupBy("survivor").agg(F.array_join(F.array_sort(F.collect_list("notes")), "\n").alias("_more"))
    out = images.join(notes.withColumnRenamed("survivor", "id"), "id", "left").withColumn("notes", note_union(F.col("notes"), F.col("_more"))).select(*images.columns)
    gone = pairs.select("id").join(used.select("id"), "id", "left_anti").distinct()
    kept = out.join(gone, "id", "left_anti")
    if tags is None:
        return kept, gone
    handed = tags.join(pairs.withColumnRenamed("id", "image_id"), "image_id").select(F.col("survivor").alias("image_id"), "tag")
    return kept, gone, tags.select("image_id", "tag").union(handed).distinct().join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti")


# What absorb does where a key says which duplicates go to which survivors, so that there is no row for each two of them.


def absorbed_ids(duplicates: DataFrame, survivors: DataFrame, key: str, used: DataFrame) -> DataFrame:
    """duplicates and survivors: key, id. The ids of duplicates that another image of their key takes up, but for used ones."""
    ends = survivors.groupBy(key).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    return duplicates.join(ends, key).where("id <> _low or id <> _high").select("id").distinct().join(used.select("id"), "id", "left_anti")


def absorbed_notes(images: DataFrame, duplicates: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """images, where survivors also have the lines of their duplicates' notes, in the order of absorb. The lines of a key are
    put together once, and those of several keys once for all survivors that have the same ones."""
    lines = images.join(duplicates, "id").select(key, "notes", F.posexplode(F.split("notes", "\n")).alias("_at", "_line")).withColumn("_line", F.trim("_line")).where("_line <> ''")
    first = lines.groupBy(key, "_line").agg(F.min(F.struct("notes", "_at")).alias("_f"))
    placed = numbered_within(first.select(key, "_line", "_f.*"), [], [F.asc("notes"), F.asc("_at")], "_no")
    each = survivors.groupBy("id").agg(F.array_sort(F.collect_set(key)).alias("_keys"))
    sets = each.select("_keys").distinct().withColumn(key, F.explode("_keys")).join(placed.select(key, "_no", "_line"), key)
    once = sets.groupBy("_keys", "_line").agg(F.min("_no").alias("_no")).groupBy("_keys").agg(F.array_sort(F.collect_list(F.struct("_no", "_line"))).alias("_l"))
    more = each.join(once.select("_keys", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("_more")), "_keys").select("id", "_more")
    return images.join(more, "id", "left").withColumn("notes", note_union(F.col("notes"), F.col("_more"))).select(*images.columns)


def absorbed_tags(tags: DataFrame, duplicates: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """tags (image_id, tag), where survivors also have those of their duplicates."""
    own = tags.join(duplicates.withColumnRenamed("id", "image_id"), "image_id").select(key, "tag").distinct()
    return tags.select("image_id", "tag").union(survivors.join(own, key).select(F.col("id").alias("image_id"), "tag")).distinct()
