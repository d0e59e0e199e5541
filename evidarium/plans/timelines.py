"""Timelines from uncertain dates, by interval sweeps.

An observation says that an object was in a state on some day of a range: a year, a month or a day. A state holds until
another is observed. On a given day a state is possible if some choice of days within the ranges makes it the latest
observed, and certain if every choice does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import partial_date

POSSIBLE, CERTAIN = "possible", "certain"


def observations(states: DataFrame, keys: list[str], state: str, date: str) -> DataFrame:
    """keys, _state, _a and _b: first and last day of the range as day numbers. Rows whose date says nothing are left out."""
    first, last = partial_date(F.col(date))
    days = states.select(*keys, F.col(state).alias("_state"), F.unix_date(first).alias("_a"), F.unix_date(last).alias("_b"))
    return days.where("_a is not null").distinct()


def possible_ranges(seen: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _state, _first, _last (null: open) of the days on which a state is possible, parted where it is not.

    An observation may be the latest from the first day of its range up to the day before some observation has surely been
    made that surely follows it. It does not matter whether that one is of another state: if it is not, its own range of
    days goes on from there. So one pass over the range ends in falling order finds the bound of each."""
    places = seen.select(*keys, F.col("_a").alias("_at"), F.col("_b").alias("_end"), F.lit(False).alias("_asks"), "_state", "_a")
    asks = seen.select(*keys, F.col("_b"), F.lit(None).cast("int"), F.lit(True), "_state", "_a").toDF(*places.columns)
    later = Window.partitionBy(*keys).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    until = places.unionByName(asks).withColumn("_next", F.min("_end").over(later)).where("_asks")
    open_end = F.lit(2**31 - 1)
    spans = until.select(*keys, "_state", F.col("_a").alias("_first"), F.coalesce(F.col("_next") - 1, open_end).alias("_last"))
    order = Window.partitionBy(*keys, "_state").orderBy("_first", "_last")
    reach = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A range that has been open so far takes in all that follows.
    begins = reach.isNull() | ((reach < open_end) & (F.col("_first") > F.least(reach, open_end - 1) + 1))
    island = F.sum(F.col("_begins").cast("long")).over(order)
    spans = spans.withColumn("_begins", begins).withColumn("_island", island)
    out = spans.groupBy(*keys, "_state", "_island").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    return out.select(*keys, "_state", "_first", F.nullif("_last", open_end).alias("_last"))


def certain_ranges(possible: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _state, _first, _last of the days on which one state alone is possible and has surely been observed."""
    code = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_state")).cast("long")
    coded = possible.withColumn("_code", code)
    known = seen.groupBy(*keys).agg(F.min("_b").alias("_at"))
    starts = coded.select(*keys, F.col("_first").alias("_at"), F.lit(1).cast("long").alias("_n"), "_code", F.lit(0).alias("_known"))
    stops = coded.where("_last is not null").select(*keys, (F.col("_last") + 1).alias("_at"), F.lit(-1).cast("long").alias("_n"), (-F.col("_code")).alias("_code"), F.lit(0).alias("_known"))
    surely = known.select(*keys, "_at", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_code"), F.lit(1).alias("_known"))
    days = starts.unionByName(stops).unionByName(surely).groupBy(*keys, "_at").agg(F.sum("_n").alias("_n"), F.sum("_code").alias("_code"), F.sum("_known").alias("_known"))
    order = Window.partitionBy(*keys).orderBy("_at")
    # With one state possible, the sum of the codes of all possible ones is its code.
    run = days.select(*keys, "_at", F.sum("_n").over(order).alias("_n"), F.sum("_code").over(order).alias("_code"), F.sum("_known").over(order).alias("_known"), (F.lead("_at").over(order) - 1).alias("_last"))
    alone = run.where("_n = 1 and _known > 0").withColumn("_begins", ~F.coalesce((F.lag("_code").over(order) == F.col("_code")) & (F.lag("_last").over(order) == F.col("_at") - 1), F.lit(False)))
    alone = alone.withColumn("_island", F.sum(F.col("_begins").cast("long")).over(order))
    # A null end is open, and only the last of a run can have one.
    whole = alone.groupBy(*keys, "_code", "_island").agg(F.min("_at").alias("_first"), F.max_by("_last", "_at").alias("_last"))
    names = coded.select(*keys, "_code", "_state").distinct()
    both = whole.alias("w").join(names.alias("s"), [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_code")])
    return both.select(*[F.col(f"w.{k}").alias(k) for k in keys], "_state", "_first", "_last")


def uncertain_timeline(states: DataFrame, keys: list[str], state: str, date: str) -> DataFrame:
    """keys, state, kind (possible or certain), date_start, date_end (null: up to now) from rows with a partial date each.

    Ranges of one kind and state neither touch nor overlap; those of different states overlap where either may hold, and
    states that are observed on the same day are both possible until something later is observed. Rows without a readable
    date are left out; null keys are one object, a null state is a state; repeated rows change nothing. An object's rows are
    sorted in one task; they are streamed, not held."""
    seen = observations(states, keys, state, date)
    possible = possible_ranges(seen, keys)
    both = possible.withColumn("kind", F.lit(POSSIBLE)).unionByName(certain_ranges(possible, seen, keys).withColumn("kind", F.lit(CERTAIN)))
    return both.select(*keys, F.col("_state").alias(state), "kind", F.date_from_unix_date("_first").alias("date_start"), F.date_from_unix_date("_last").alias("date_end"))


def contradictions(states: DataFrame, keys: list[str], state: str, date: str) -> DataFrame:
    """keys, date and states: days for which several states of an object are given as exact dates."""
    exact = observations(states, keys, state, date).where("_a = _b").groupBy(*keys, "_a").agg(F.array_sort(F.collect_set("_state")).alias("states"))
    return exact.where("size(states) > 1").select(*keys, F.date_from_unix_date("_a").alias("date"), "states")
