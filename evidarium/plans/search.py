"""Entity search through an index of letter triples.

An index has three tables: the distinct lower-case texts that entities are found by, the triples of each, and for each text
the first entities of every type that carry it. A query is answered by the texts that have its rarest triple, which are
then compared with the whole pattern. Entities with the same text are compared once, and no more of them are read than a
result can hold, so a subtitle that millions share costs as much as any other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import like_any
from ..operators.windows import first_per
from ..sources.shared import kept
from .catalog import entity_index

#: A result has at most so many entities of a type, and so many in all.
MOST = 100
#: Short or wild queries that are compared with all texts at a time.
BLOCK_QUERIES = 1000
TYPES = ("kit", "part", "model", "image", "source")
TABLES = ("texts", "postings", "holders")


class SearchIndex(NamedTuple):
    texts: DataFrame  # text_id, low
    postings: DataFrame  # gram, text_id, n (texts that have the gram)
    holders: DataFrame  # text_id, type, id, title, subtitle, badges, held (place among the type's entities with the text)

    def write(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def grams(text: Column) -> Column:
    """The distinct letter triples of a text; none if it is shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3)))


def query_grams(pattern: Column) -> Column:
    """The triples that whatever matches the pattern has: those of its parts between wildcards."""
    parts = F.filter(F.split(pattern, "[%_]"), lambda p: F.length(p) >= 3)
    return F.array_distinct(F.flatten(F.transform(parts, grams)))


def build_index(entities: DataFrame) -> SearchIndex:
    """entities: type, id, title, subtitle, badges, as entity_index gives them. Null titles and subtitles count as empty;
    an entity whose title is its subtitle has one text; an empty table gives an index that finds nothing."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    by_text = entities.withColumn("low", F.explode(F.array_distinct(F.array(low("title"), low("subtitle")))))
    first = kept(first_per(by_text, ["low", "type"], [F.asc("title"), F.asc("id")], MOST, rank="held"), "search-holders")
    texts = kept(first.select("low").distinct().withColumn("text_id", F.monotonically_increasing_id()), "search-texts")
    holders = first.join(texts, "low").select("text_id", "type", "id", "title", "subtitle", "badges", "held")
    pairs = kept(texts.where(F.length("low") >= 3).select("text_id", F.explode(grams(F.col("low"))).alias("gram")), "search-grams")
    counts = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return SearchIndex(texts, kept(pairs.join(counts, "gram"), "search-postings"), kept(holders, "search-entities"))


def matching_texts(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(text, text_id) for the distinct texts of queries. Each is looked up by its rarest triple; one with a triple that no
    text has finds nothing. Only what has no three letters in a row is compared with all texts, in blocks."""
    own = asked.select("text", query_grams(F.lower("text")).alias("grams")).distinct()
    pattern = like_any(F.col("text"), F.col("low"))
    counts = index.postings.groupBy("gram").agg(F.first("n").alias("n"))
    each = own.where("size(grams) > 0").select("text", F.explode("grams").alias("gram")).join(counts, "gram", "left")
    rarest = each.groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "gram")).alias("r")).where("r.n > 0")
    found = rarest.select("text", F.col("r.gram").alias("gram")).join(index.postings.select("gram", "text_id"), "gram")
    found = found.join(index.texts, "text_id").where(pattern).select("text", "text_id")
    wild = own.where("size(grams) = 0").select("text")
    blocks = -(-wild.count() // BLOCK_QUERIES)
    for b in range(blocks):
        mine = wild.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        found = found.unionByName(index.texts.join(F.broadcast(mine), pattern).select("text", "text_id"))
    return found


def search_index(index: SearchIndex, queries: DataFrame, per_type: int = 5, limit: int = 20, types: tuple[str, ...] = TYPES) -> DataFrame:
    """What catalog.search gives, through the index. queries: query_id, text, and if there are such columns types (array;
    empty and unknown ones mean all) and limit (1 to 100). Hits per query: the first of each type, then the first of all,
    with their place by type, title, id; texts under two characters, and null ones, find nothing."""
    per_type, limit = min(max(per_type, 1), MOST), min(max(limit, 1), MOST)
    known = F.array(*map(F.lit, types))
    own = F.array_intersect(F.col("types"), known) if "types" in queries.columns else known
    most = F.least(F.greatest(F.coalesce(F.col("limit"), F.lit(limit)), F.lit(1)), F.lit(MOST)) if "limit" in queries.columns else F.lit(limit)
    asked = queries.where("length(trim(text)) >= 2").select("query_id", "text", F.when(F.size(F.coalesce(own, known)) > 0, own).otherwise(known).alias("_types"), most.alias("_limit"))
    asked = asked.withColumn("_types", F.coalesce("_types", known))
    texts = matching_texts(index, asked.select("text").distinct())
    held = index.holders.where(F.col("held") <= per_type).drop("held")
    once = texts.join(held, "text_id").drop("text_id").groupBy("text", "type", "id").agg(*[F.first(c).alias(c) for c in ("title", "subtitle", "badges")])
    top = first_per(once, ["text", "type"], [F.asc("title"), F.asc("id")], per_type)
    hits = asked.join(top, "text").where(F.array_contains("_types", F.col("type")))
    return first_per(hits, ["query_id"], [F.asc("type"), F.asc("title"), F.asc("id")], MOST, rank="place").where("place <= _limit").drop("text", "_types", "_limit")


def catalog_index(c, types: tuple[str, ...] = TYPES) -> SearchIndex:
    return build_index(entity_index(c, types))
