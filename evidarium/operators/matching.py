"""Joins that link: unique matches, nearest rectangles, prioritised fallbacks, keyword titles, crosswalks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import centre
from ..functions.text import match_key


def unique_match(labels: DataFrame, label: str, entities: DataFrame, name: str, key: str = "id") -> DataFrame:
    """labels with match_id and match_status: linked only where exactly one entity has the label's key."""
    keys = entities.select(match_key(F.col(name)).alias("_k"), F.col(key).alias("_id")).where("_k <> ''").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("match_id"))
    out = labels.withColumn("_k", match_key(F.col(label))).join(keys, "_k", "left")
    status = F.when(F.col("_n") == 1, "linked").when(F.col("_n") > 1, "ambiguous_exact_match").otherwise("no_exact_match")
    return out.withColumns({"match_status": status, "match_id": F.when(F.col("_n") == 1, F.col("match_id"))}).drop("_k", "_n")


#: Distances that are worked out in one go.
DISTANCES = 1_000_000


def first_nearest(px: np.ndarray, py: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """For each point the first of the nearest boxes (left, low, right, high); a missing side, nan, is no distance."""
    left, low, right, high = boxes
    step, best = max(1, DISTANCES // len(left)), []
    for s in range(0, len(px), step):
        x, y = px[s : s + step, None], py[s : s + step, None]
        best.append(np.hypot(np.fmax(np.fmax(left - x, 0), x - right), np.fmax(np.fmax(low - y, 0), y - high)).argmin(axis=1))
    return np.concatenate(best)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels with their pictures, from rows in order of slides, the pictures of each before its labels."""
    slide, shown, boxes = None, [], []
    for batch in batches:
        runs, own, found = pc.run_end_encode(batch["slide"]), batch["own"].to_numpy(zero_copy_only=False), []
        sides = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("left", "low", "right", "high")])
        start = 0
        for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if value is None or value != slide:
                slide, shown, boxes = value, [], []
            said = start + int(np.count_nonzero(~own[start:end]))
            if said > start:
                shown.append(batch["p"].slice(start, said - start))
                boxes.append(sides[:, start:said])
            if end > said and shown:
                shown, boxes = [pa.concat_arrays(shown)], [np.concatenate(boxes, axis=1)]
                found.append(shown[0].take(pa.array(first_nearest(sides[0, said:end], sides[1, said:end], boxes[0]))))
            elif end > said:
                found.append(pa.nulls(end - said, batch["p"].type))
            start = end
        if found:
            yield pa.RecordBatch.from_arrays([batch["l"].filter(pa.array(own)), pa.concat_arrays(found)], ["l", "p"])


def nearest_picture(labels: DataFrame, pictures: DataFrame) -> DataFrame:
    """Each label with the picture of its slide that holds its centre or is nearest to it; ties go to the larger, then to
    the first. Labels come after the pictures of their slide, as many as one slide shows, in one task, so no row is made for
    a label and a picture; a label of a slide without pictures has nulls."""
    names = [c for c in pictures.columns if c != "slide"]
    cx, cy = centre(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    sides = lambda *v: [F.lit(None).cast("double").alias(k) if c is None else c.cast("double").alias(k) for k, c in zip(("left", "low", "right", "high"), v)]
    l_type, p_type = T.StructType(labels.schema.fields), T.StructType([pictures.schema[c] for c in names])
    l, p = F.struct(*labels.columns).alias("l"), F.struct(*names).alias("p")
    # Labels without a slide are dealt by their values, not all to one task.
    deal = F.when(F.col("slide").isNull(), F.pmod(F.xxhash64(*labels.columns), F.lit(100_000))).otherwise(F.lit(0).cast("long")).alias("deal")
    none = lambda kind: F.lit(None).cast(kind)
    said = labels.select("slide", deal, F.lit(True).alias("own"), *sides(cx, cy, None, None), none("double").alias("small"), none(pictures.schema["idx"].dataType).alias("i"), l, none(p_type).alias("p"))
    shown = pictures.where("slide is not null").select(
        "slide", F.lit(0).cast("long").alias("deal"), F.lit(False).alias("own"), *sides(F.col("x"), F.col("y"), F.col("x") + F.col("cx"), F.col("y") + F.col("cy")),
        F.coalesce(-F.col("area"), F.lit(float("inf"))).cast("double").alias("small"), F.col("idx").alias("i"), none(l_type).alias("l"), p,
    )
    rows = shown.unionByName(said).repartition("slide", "deal").sortWithinPartitions("slide", "deal", "own", "small", "i", "p")
    rows = rows.select("slide", "own", "left", "low", "right", "high", "l", "p")
    out = rows.mapInArrow(met, T.StructType([T.StructField("l", l_type), T.StructField("p", p_type)]))
    return out.select(*[F.col("l")[c].alias(c) for c in labels.columns], *[F.col("p")[c].alias(f"p_{c}") for c in names])


def fallback_match(df: DataFrame, keys: list[str], target: DataFrame, key: str, value: str) -> DataFrame:
    """df with matched: the value of the first of several keys that the target has, and matched_by, which. Of several values
    of one key the smallest counts. Rows without a key are dealt by their other values, not all to one task."""
    found, kinds = [], dict(df.dtypes)
    for i, k in enumerate(keys):
        side = target.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        dealt = F.coalesce(k, F.pmod(F.xxhash64(*df.columns), F.lit(100_000)).cast(kinds[k]))
        df = df.join(side, (dealt == F.col(f"_k{i}")) & F.col(k).isNotNull(), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    by = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(k)) for v, k in zip(found, keys)])
    return df.withColumns({"matched": F.coalesce(*found), "matched_by": by}).drop(*found)


def crosswalk(left: DataFrame, right: DataFrame, digest: str, name: str) -> DataFrame:
    """left with the first name under which right has the same content."""
    names = right.groupBy(digest).agg(F.min(name).alias("other_name"))
    return left.join(names, digest, "left")


def keyword_variants(models: DataFrame, name: str = "name") -> DataFrame:
    """Keywords of model names: without what stands in brackets, with hyphens and with spaces."""
    bare = F.trim(F.regexp_replace(F.lower(F.col(name)), r"\s*\([^)]*\)", ""))
    forms = F.array_distinct(F.array(bare, F.replace(bare, F.lit("-"), F.lit(" ")), F.replace(bare, F.lit(" "), F.lit("-"))))
    return models.select(F.explode(forms).alias("keyword")).where("keyword <> ''").distinct()


def word_sets(df: DataFrame) -> DataFrame:
    """(id, words, n): the sorted distinct words of each name, one blank apart, and their number; names without words go."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != "")))
    return df.select("id", words.alias("_w")).where("size(_w) > 0").select("id", F.array_join("_w", " ").alias("words"), F.size("_w").cast("long").alias("n"))


def similar_sets(left: DataFrame, right: DataFrame, at_least: float = 0.5) -> DataFrame:
    """(left_words, right_words, similarity) of the distinct sets of two tables of word_sets, by the Jaccard index. Two sets
    that reach it share one of the rarest words of each, so only those meet, and only sets of fitting sizes."""
    a, b = left.select("words", "n").distinct(), right.select("words", "n").distinct()
    entries = lambda df: df.select("words", "n", F.explode(F.split("words", " ")).alias("w"))
    counts = entries(a).unionByName(entries(b)).groupBy("w").agg(F.count(F.lit(1)).alias("c"))

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        rarest = entries(df).join(counts, "w").groupBy("words", "n").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("all"))
        length = F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1
        rarest = rarest.select(F.col("words").alias(f"{side}_words"), F.col("n").alias(f"{side}_n"), F.transform(F.slice("all", 1, length.cast("int")), lambda x: x["w"]).alias(f"{side}_prefix"))
        return rarest.withColumn("w", F.explode(f"{side}_prefix"))

    pairs = prefixes(a, "left").join(prefixes(b, "right"), "w").where((F.col("left_n") >= F.col("right_n") * at_least - 1e-9) & (F.col("right_n") >= F.col("left_n") * at_least - 1e-9))
    pairs = pairs.where(F.array_intersect("left_prefix", "right_prefix")[0] == F.col("w"))  # each pair once
    k = F.size(F.array_intersect(F.split("left_words", " "), F.split("right_words", " ")))
    return pairs.select("left_words", "right_words", (k / (F.col("left_n") + F.col("right_n") - k)).alias("similarity")).where(F.col("similarity") >= at_least)


def token_similarity(left: DataFrame, right: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Suggestions beyond exact matches: (left_id, right_id, similarity) of names that share a word, by the Jaccard index
    of their words. Names of equal words are compared once; where they are many, similar_sets and word_sets say the same
    without a row for each pair of ids."""
    a, b = word_sets(left), word_sets(right)
    ids = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col("words").alias(f"{side}_words"))
    return similar_sets(a, b, at_least).join(ids(a, "left"), "left_words").join(ids(b, "right"), "right_words").select("left_id", "right_id", "similarity")
