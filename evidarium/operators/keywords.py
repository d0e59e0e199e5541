"""Keyword tables of any size against texts: whole words and phrases, found by joins on the words they begin with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, squeezed
from ..sources.shared import kept

#: Kinds of keywords and their points; the last counts only beside relevance or the first.
POINTS = {"model": 3, "resource": 2, "research": 2}
RELEVANT = 2


#: A keyword's first word, and its second if one blank stands between.
LEAD = "[a-z0-9]+( [a-z0-9]+)?"


def leads(norm: Column) -> Column:
    """What a keyword may begin with at some place of a normalised text: each word, and each two with one blank between."""
    words, pairs = F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)), F.regexp_extract_all(norm, F.lit("(?<![a-z0-9])(?=([a-z0-9]+ [a-z0-9]+))"), F.lit(1))
    return F.array_distinct(F.concat(words, pairs))


def keyword_table(keywords: DataFrame, *kinds: str) -> DataFrame:
    """(kinds, keyword, norm, lead): each normalised keyword once per kind, in the spelling that comes first. Keywords that are
    null or have no letter or digit of a-z, 0-9 are left out, as they are no words."""
    named = keywords.select(*kinds, "keyword", squeezed(nfkc(F.col("keyword"))).alias("norm")).withColumn("lead", F.regexp_extract("norm", LEAD, 0))
    return named.where("lead <> ''").groupBy(*kinds, "norm", "lead").agg(F.min("keyword").alias("keyword"))


def keyword_matches(texts: DataFrame, keywords: DataFrame, text: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(id, kinds, keyword): every keyword that stands as whole words in a text, once. texts has a unique id; text is its column
    of texts. Both sides are compared in compatibility form, lower case, with hyphens, underscores and white space as one
    blank; before and after a keyword stands no letter or digit of a-z, 0-9. Null and empty texts have none.

    The keywords are written down first, so Spark knows their size and broadcasts them if they are few. A text gives a row for
    each of its words and pairs of words, once; those that some keyword begins with stay, by a join. Keywords of more than a
    lead, if there are any, are then compared with the text as a whole; no text meets one whose lead it lacks."""
    table = kept(keyword_table(keywords, *kinds), "keywords")
    named = texts.select("id", squeezed(nfkc(F.col(text))).alias("_text"))
    found = named.select("id", F.explode(leads(F.col("_text"))).alias("lead")).join(table, "lead")
    if table.where("norm <> lead").isEmpty():
        return found.select("id", *kinds, "keyword")
    found = kept(found, "keywords-found")
    done = found.where("norm = lead").select("id", *kinds, "keyword")
    longer = found.where("norm <> lead").select("id", *kinds, "keyword", "norm").join(named, "id")
    # A keyword in lower case has no \E that could end the quotation.
    bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("norm"), F.lit(r"\E(?![a-z0-9])"))
    return done.unionByName(longer.where(F.rlike("_text", bounded)).select("id", *kinds, "keyword"))


def scored_titles(titles: DataFrame, keywords: DataFrame, relevant: Column, title: str = "title") -> DataFrame:
    """titles (unique id) with tier, score and reasons, as rules.score_titles gives them, by a table of keywords: kind (model,
    resource or research) and keyword. Titles without a hit stay; other kinds count nothing."""
    hits = keyword_matches(titles, keywords.where(F.col("kind").isin(*POINTS)), title, ("kind",))
    first = hits.groupBy("id").agg(*[F.min(F.when(F.col("kind") == k, F.col("keyword"))).alias(f"_{k}") for k in POINTS])
    out = titles.withColumn("_f", F.coalesce(relevant, F.lit(False))).join(first, "id", "left")
    m, r = F.col("_model").isNotNull(), F.col("_resource").isNotNull()
    s = F.col("_research").isNotNull() & (F.col("_f") | m)
    score = F.col("_f").cast("int") * RELEVANT + m.cast("int") * POINTS["model"] + r.cast("int") * POINTS["resource"] + s.cast("int") * POINTS["research"]
    reason = lambda holds, k: F.when(holds, F.concat(F.lit(f"{k}:"), F.col(f"_{k}")))
    reasons = F.array_compact(F.array(F.when(F.col("_f"), F.lit("filter")), reason(m, "model"), reason(r, "resource"), reason(s, "research")))
    tier = F.when(m | r | s, "strong").when(F.col("_f"), "candidate").otherwise("exclude")
    return out.withColumns({"score": score, "tier": tier, "reasons": reasons}).select(*titles.columns, "tier", "score", "reasons")


def tagged_posts(posts: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """posts (unique id) with keyword, a row for every keyword of the table that a post has: candidates for review."""
    return posts.join(keyword_matches(posts, keywords, text), "id")
