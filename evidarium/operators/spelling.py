"""Names that differ by a few letters: candidates from deletion neighbourhoods, verified by their edit distance.

If at most d letters of one name must be inserted, deleted or exchanged to get the other, then some string comes from both
by deleting at most d letters. So names meet only on such strings, and names that meet are never more than 2d apart: a
word or a prefix that all names share brings none together. Long names have too many such strings; they meet on an intact
piece instead, as one of d + 1 pieces of a name must stand in the other, moved by at most d places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of more letters are cut into pieces.
LONG = 48


def bare(name: Column) -> Column:
    return F.lower(F.trim(name))


def without_a_letter(texts: Column) -> Column:
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.flatten(F.transform(F.filter(texts, lambda s: F.length(s) > 0), one))


def deletions(name: Column, within: int) -> Column:
    """Hashes of all strings that come from a name by deleting at most so many letters. Two strings with one hash only meet
    in vain."""
    made = last = F.array(name)
    for _ in range(within):
        last = F.array_distinct(without_a_letter(last))
        made = F.concat(made, last)
    return F.array_distinct(F.transform(made, lambda s: F.xxhash64(s)))


def pieces(name: Column, within: int) -> Column:
    """Hashes of (length, number, text) of the within + 1 pieces of a name."""
    size, k = F.length(name), within + 1
    start = lambda i: F.floor(i * size / k).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(within)), lambda i: F.xxhash64(size, i, F.substring(name, start(i) + 1, start(i + 1) - start(i))))


def places(name: Column, within: int) -> Column:
    """Hashes of what would be a piece of a name of about this length, at about its place."""
    k = within + 1
    start = lambda size, i: F.floor(i * size / k).cast("int")

    def of(size: Column, i: Column) -> Column:
        a, n = start(size, i), start(size, i + 1) - start(size, i)
        at = F.sequence(F.greatest(a - within, F.lit(0)), a + within)
        return F.transform(at, lambda p: F.xxhash64(size, i, F.substring(name, p + 1, n)))

    sizes = F.sequence(F.length(name) - within, F.length(name) + within)
    every = F.transform(sizes, lambda size: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(within)), lambda i: of(size, i))))
    return F.array_distinct(F.flatten(every))


def close_names(left: DataFrame, right: DataFrame, within: int = 2, long: int = LONG) -> DataFrame:
    """(left_name, right_name, distance) of the distinct names of two tables (column name) that are at most `within` edits
    apart, in lower case and without blanks around them. Names that both tables have are pairs at distance 0. Null and
    blank names are left out; an empty table gives no rows. ids are found by a join on bare(name), so that equal names are
    compared once."""
    if within < 1:
        raise ValueError("within must be 1 or more")
    if long < 4 * within:
        raise ValueError("long must be four times within, or pieces would be too short to tell names apart")
    names = lambda df: df.select(bare(F.col("name")).alias("name")).where("name <> ''").distinct()
    a, b = names(left), names(right)
    size = F.length("name")
    keyed = lambda df, keys, side: df.select(F.col("name").alias(f"{side}_name"), F.explode(keys).alias("k"))
    # A name within reach of a long one may be shorter than it, so names about the bound go both ways.
    near = keyed(a.where(size <= long), deletions(F.col("name"), within), "left").join(keyed(b.where(size <= long), deletions(F.col("name"), within), "right"), "k")
    far = keyed(a.where(size > long - within), pieces(F.col("name"), within), "left").join(keyed(b.where(size > long - within), places(F.col("name"), within), "right"), "k")
    far = far.where((F.length("left_name") > long) | (F.length("right_name") > long))
    met = near.unionByName(far).where(F.abs(F.length("left_name") - F.length("right_name")) <= within).select("left_name", "right_name").distinct()
    return met.withColumn("distance", F.levenshtein("left_name", "right_name", within)).where("distance >= 0")
