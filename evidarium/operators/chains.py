"""Chains of rows that each name the row before: roots, depths, paths and cycles, by pointer doubling.

Every row holds a pointer to the row 2^k steps before it. One join of the pointers with themselves doubles the steps, so a
chain of a million rows takes twenty joins and no recursion. After as many steps as there are rows, a pointer that has not
come to a root stands on a cycle, and what its row has passed on the way is the whole of it.

Without paths, rows are first sorted by id and followed within pieces of bounded length; only rows that are named from another
piece then take part in the joins, with all their steps within their piece as one. Where chains name rows near by, these are
few, and all rows are moved a few times, however long the chains are; where they name rows anywhere, most take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept

#: Rows of a piece that is followed in one go.
PIECE = 1_000_000


def chains(rows: DataFrame, key: str, before: str, label: str | None = None, sep: str = "/") -> DataFrame:
    """(id, root, depth, cycle, on_cycle, dangling, and path if there is a label) of every id.

    root is where the chain of an id begins, depth how many steps away; a row that names a missing row is a root, and
    dangling. Ids whose chain runs into a cycle have no root and no depth; cycle is the cycle's smallest id and on_cycle
    whether the id itself is on it, else it only leads there. path joins the labels from the root on; null on cycles, a
    null label counting as empty. Of several rows with one id the one with the smallest `before` counts (null last); rows
    without an id are left out; an empty table gives no rows."""
    one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.struct(F.col(before).isNull(), F.col(before), *([F.coalesce(F.col(label), F.lit("")).alias("label")] if label else []))).alias("r"))
    one = one.select("id", F.col(f"r.{before}").alias("before"), *([F.col("r.label").alias("path")] if label else []))
    if not label:
        return by_pieces(one)
    there = one.select(F.col("id").alias("before"), F.lit(True).alias("there"))
    state = one.join(there, "before", "left").select(
        "id", F.when(F.col("there"), F.col("before")).alias("up"), F.when(F.col("there"), F.lit(1)).otherwise(0).cast("long").alias("steps"), F.col("id").alias("least"),
        (F.col("before").isNotNull() & F.col("there").isNull()).alias("lost"), *(["path"] if label else []),
    )
    # root: the last row reached; once up is null nothing is left to do for a row.
    return finished(doubled(state.withColumn("root", F.coalesce("up", "id")), label, sep), label)


def doubled(state: DataFrame, label: str | None = None, sep: str = "/") -> DataFrame:
    """state, its pointers followed until they end or have gone as far as there are rows."""
    state = kept(state, "chains")
    total, walked = state.count(), 1
    while walked < total and state.where("up is not null").take(1):
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("least").alias("lower"), F.col("root").alias("far"), F.col("lost").alias("out"), *([F.col("path").alias("head")] if label else []))
        going = state.where("up is not null").join(ahead, "up")
        path = [F.concat("head", F.lit(sep), "path").alias("path")] if label else []
        going = going.select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "lower").alias("least"), F.col("out").alias("lost"), *path, F.col("far").alias("root"))
        state = kept(state.where("up is null").unionByName(going), "chains")
        walked *= 2
    return state


def within(ids: pa.Array, before: pa.Array) -> dict[str, pa.Array]:
    """Chains within one piece, its ids in order: last (the last row reached), exit (what it names), steps up to it, least id
    on the way, and cycle and on_cycle for rows that lead round within the piece. Of rows
    with one last row, those that lead to a row are the ones whose place is from its own place on and below its stop."""
    n, up = len(ids), pc.fill_null(pc.index_in(before, ids), -1).to_numpy()
    at = np.where(up < 0, np.arange(n), up)
    steps, least = (up >= 0).astype(np.int64), np.minimum(at, np.arange(n))
    for _ in range(n.bit_length()):
        steps, least, at = steps + steps[at], np.minimum(least, least[at]), at[at]
    rings = up[at] >= 0
    on = np.zeros(n, bool)
    on[at[rings]] = True
    # Sizes of what leads to each row, from the far ends on, then places from the last row on.
    order = [v for v in np.argsort(np.where(rings, -1, steps), kind="stable").tolist() if not rings[v]]
    named, size = up.tolist(), [1] * n
    for v in reversed(order):
        if named[v] >= 0:
            size[named[v]] += size[v]
    place, free = [0] * n, [1] * n
    for v in order:
        if named[v] >= 0:
            place[v] = free[named[v]]
            free[named[v]] += size[v]
            free[v] = place[v] + 1
    held = lambda index, mask: ids.take(pa.array(index, mask=mask))
    return {
        "id": ids, "last": held(at, rings), "exit": pc.if_else(pa.array(rings), None, before.take(pa.array(at))), "steps": pa.array(steps), "least": ids.take(pa.array(least)),
        "cycle": held(least[at], ~rings), "on_cycle": pa.array(on), "place": pa.array(place, pa.int64()), "stop": pa.array(np.add(place, size), pa.int64()),
    }


def follower(size: int):
    """For sorted rows (id, before): within, of each size rows or a little more."""

    def piece(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, before = (pa.chunked_array([b[c] for b in some]).combine_chunks() for c in ("id", "before"))
        yield from pa.table(within(ids, before)).to_batches(max_chunksize=100_000)

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                some.append(batch.slice(start, size))
                held += some[-1].num_rows
                if held >= size:
                    yield from piece(some)
                    some, held = [], 0
        if some:
            yield from piece(some)

    return followed


def by_pieces(one: DataFrame) -> DataFrame:
    kind = one.select(F.coalesce("id", "before").alias("id")).schema["id"].dataType
    own = dict(one.dtypes)["id"]
    keys = {c: kind for c in ("last", "exit", "least", "cycle")} | {"steps": T.LongType(), "on_cycle": T.BooleanType(), "place": T.LongType(), "stop": T.LongType()}
    schema = T.StructType([T.StructField("id", kind)] + [T.StructField(c, keys[c]) for c in ("last", "exit", "steps", "least", "cycle", "on_cycle", "place", "stop")])
    rows = kept(one.select(F.col("id").cast(kind), F.col("before").cast(kind)).orderBy("id").mapInArrow(follower(PIECE), schema), "chains-pieces")
    # Last rows that name a row elsewhere, and the rows they name: the chains from piece to piece.
    ends = kept(rows.where("exit is not null and id = last").select("last", "exit"), "chains-ends")
    named = kept(ends.select(F.col("exit").alias("id")).distinct(), "chains-named")
    entries = kept(rows.join(named, "id", "left_semi"), "chains-entries")
    there = entries.select(F.col("id").alias("exit"), F.lit(True).alias("there"))
    linked = entries.join(there, "exit", "left")
    up = F.when(F.col("there"), F.col("exit"))
    # A row that leads round within its piece counts as ended there.
    state = linked.select("id", up.alias("up"), (F.col("steps") + F.col("there").isNotNull().cast("long")).alias("steps"), "least", (F.col("exit").isNotNull() & F.col("there").isNull()).alias("lost"), F.when(F.col("cycle").isNotNull(), F.col("id")).otherwise(F.coalesce(up, "last")).alias("root"))
    found = finished(doubled(state), None)
    inner = entries.where("cycle is not null").select(F.col("id").alias("root"), F.col("cycle").alias("inner"))
    found = found.join(inner, "root", "left").select(F.col("id").alias("exit"), F.when(F.col("inner").isNull(), F.col("root")).alias("far"), F.when(F.col("inner").isNull(), F.col("depth")).alias("more"), F.coalesce("cycle", "inner").alias("ring"), F.col("on_cycle").alias("on"), F.col("dangling").alias("lost"))
    found = kept(found, "chains-found")
    # Where a circle enters a piece; a last row is passed by one circle at most.
    through = entries.join(found.where("on").select(F.col("exit").alias("id")), "id").select("last", F.col("place").alias("enters"))
    ends = kept(ends.join(found.drop("on"), "exit", "left").join(through, "last", "left").drop("exit"), "chains-ends")
    out = rows.join(ends, "last", "left")
    known, ended = F.col("lost").isNotNull(), F.col("cycle").isNull() & F.col("ring").isNull()
    return out.select(
        F.col("id").cast(own), F.when(ended, F.coalesce("far", "last")).alias("root"), F.when(ended, F.col("steps") + F.when(known, F.col("more") + 1).otherwise(0)).alias("depth"), F.coalesce("cycle", "ring").cast(own).alias("cycle"),
        (F.col("on_cycle") | F.coalesce((F.col("enters") >= F.col("place")) & (F.col("enters") < F.col("stop")), F.lit(False))).alias("on_cycle"),
        (ended & F.coalesce("lost", F.col("exit").isNotNull())).alias("dangling"),
    )


def finished(state: DataFrame, label: str | None) -> DataFrame:
    path = ["path"] if label else []
    none = F.lit(None)
    ended = state.where("up is null").select("id", "root", F.col("steps").alias("depth"), F.col("lost").alias("dangling"), *path)
    ended = ended.select("id", "root", "depth", none.cast(dict(state.dtypes)["id"]).alias("cycle"), F.lit(False).alias("on_cycle"), "dangling", *path)
    # Rows on a cycle have walked all of it, and where the pointers of all rows stand is every row of a cycle.
    rings = state.where("up is not null").select(F.col("up").alias("at")).distinct()
    least = state.where("up is not null").join(rings, F.col("id") == F.col("at")).select(F.col("id").alias("up"), F.col("least").alias("cycle"))
    round_ = state.where("up is not null").select("id", "up").join(least, "up").join(rings, F.col("id") == F.col("at"), "left")
    round_ = round_.select("id", none.cast(dict(state.dtypes)["id"]).alias("root"), none.cast("long").alias("depth"), "cycle", F.col("at").isNotNull().alias("on_cycle"), F.lit(False).alias("dangling"), *([none.cast("string").alias("path")] if label else []))
    return ended.unionByName(round_)


def cycles(found: DataFrame) -> DataFrame:
    """(cycle, rows, leading): of each cycle its rows and how many others lead to it, from chains."""
    on = F.col("on_cycle").cast("long")
    return found.where("cycle is not null").groupBy("cycle").agg(F.sum(on).alias("rows"), F.sum(1 - on).alias("leading"))
