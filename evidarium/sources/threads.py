"""Forum threads: manifests, saved pages, exported texts and the pictures in posts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import image_url, nfkc, safe_filename, squeezed, thread_id


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """thread_url, title and thread_id of a JSON file whose thread_urls hold URLs or [url, title] pairs."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = whole.lateralJoin(spark.tvf.variant_explode(F.variant_get(F.col("v").outer(), "$.thread_urls", "variant")))
    plain = F.schema_of_variant("value") == "STRING"
    url = F.when(plain, F.try_variant_get("value", "$", "string")).otherwise(F.try_variant_get("value", "$[0]", "string"))
    title = F.when(~plain, F.try_variant_get("value", "$[1]", "string"))
    return items.select(url.alias("thread_url"), title.alias("title"), F.col("pos").alias("position")).withColumn("thread_id", thread_id(F.col("thread_url")))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """thread (stem without page), page_no (0: the first; latest comes last), html of saved pages."""
    df = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.html?$", 1).alias("stem"), F.col("value").alias("html"))
    page = F.regexp_extract("stem", "_page-([0-9]+)$", 1).try_cast("int")
    rank = F.when(F.col("stem").endswith("_latest"), 2147483647).otherwise(F.coalesce(page, F.lit(0)))
    return df.select(F.regexp_replace("stem", "_(page-[0-9]+|latest)$", "").alias("thread"), rank.alias("page_no"), "html")


def parse_posts(texts: DataFrame, column: str = "value") -> DataFrame:
    """Posts of exported threads: thread, url, number, post_id, author, posted_at, body, images, and whether the file's
    own total agrees (null where it gives none)."""
    text = F.col(column)
    head = texts.select(
        F.regexp_extract(text, r"(?m)^THREAD\s*:\s*(.*?)\s*$", 1).alias("thread"), F.regexp_extract(text, r"(?m)^URL\s*:\s*(\S+)", 1).alias("url"),
        F.nullif(F.regexp_extract(text, r"Total posts:\s*([0-9]+)", 1), F.lit("")).try_cast("int").alias("total"), F.split(text, r"(?m)^(?=Post #)").alias("parts"),
    )
    head = head.select("thread", "url", "total", F.filter("parts", lambda x, i: x.startswith("Post #")).alias("posts"))
    p = F.col("post")
    out = head.select("thread", "url", (F.col("total") == F.size("posts")).alias("total_agrees"), F.posexplode("posts").alias("place", "post"))
    body = F.trim(F.regexp_replace(F.regexp_replace(p, r"(?sm)\A.*?^Date[^\n]*\n", ""), r"(?m)^([=\-]{5,}|Total posts:.*)$", ""))
    return out.select(
        "thread", "url", "total_agrees", F.regexp_extract(p, r"^Post #([0-9]+)", 1).try_cast("int").alias("number"), F.nullif(F.regexp_extract(p, r"forum post #([0-9]+)", 1), F.lit("")).alias("post_id"),
        F.regexp_extract(p, r"(?m)^Author\s*:\s*(.*?)\s*$", 1).alias("author"), F.try_to_timestamp(F.regexp_extract(p, r"(?m)^Date\s*:\s*(.*?)\s*$", 1), F.lit("MMM d, yyyy 'at' h:mm a")).alias("posted_at"),
        F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), F.regexp_extract_all(p, F.lit(r"\[IMAGE: ([^\]]+)\]"), F.lit(1)).alias("images"),
    )


class PostParser(HTMLParser):
    """Posts (article elements with data-content) with author, date and the sources of their pictures."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.posts: list[dict] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "article" and a.get("data-content"):
            self.posts.append({"post_id": a["data-content"], "author": a.get("data-author"), "posted": None, "sources": []})
            self.depth = 1
        elif tag == "article" and self.depth:
            self.depth += 1
        if not self.depth:
            return
        if tag == "time" and self.posts[-1]["posted"] is None:
            self.posts[-1]["posted"] = a.get("datetime")
        if tag == "img" and (a.get("data-src") or a.get("src")):
            self.posts[-1]["sources"].append(a.get("data-src") or a["src"])

    def handle_endtag(self, tag):
        if tag == "article" and self.depth:
            self.depth -= 1


def post_images(pages: DataFrame, base: str) -> DataFrame:
    """thread, page_no, post_id, author, posted, image_index, image_url: the pictures of each post, a URL once per post,
    numbered in order. Pages need html; parsing is Python, once per page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("post_id", pa.string()), ("author", pa.string()), ("posted", pa.string()), ("sources", pa.list_(pa.string()))]))
        for b in batches:
            found = []
            for html in b.column("html").to_pylist():
                parser = PostParser()
                parser.feed(html or "")
                found.append(parser.posts)
            yield pa.RecordBatch.from_arrays([b.column("thread"), b.column("page_no"), pa.array(found, kind)], names=["thread", "page_no", "posts"])

    read = pages.select("thread", "page_no", "html").mapInArrow(parse, "thread string, page_no int, posts array<struct<post_id:string,author:string,posted:string,sources:array<string>>>")
    post = read.select("thread", "page_no", F.posexplode("posts").alias("place", "p"))
    urls = post.select("thread", "page_no", "place", "p.post_id", "p.author", "p.posted", F.posexplode("p.sources").alias("i", "src")).withColumn("image_url", image_url(F.col("src"), base)).where("image_url is not null")
    keys = ["thread", "page_no", "place", "post_id", "author", "posted"]
    once = urls.groupBy(*keys, "image_url").agg(F.min("i").alias("i"))
    index = F.row_number().over(Window.partitionBy("thread", "page_no", "place").orderBy("i"))
    return once.select(*keys, index.alias("image_index"), "image_url")


def link_manifest(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """Pictures with the hash of their copy (blobs: image_url, sha256) and status copied or missing; of several copies of one
    picture that with the smallest hash counts."""
    return images.join(blobs.groupBy("image_url").agg(F.min("sha256").alias("sha256")), "image_url", "left").withColumn("status", F.when(F.col("sha256").isNull(), "missing").otherwise("copied"))


def thread_manifest(links: DataFrame) -> DataFrame:
    return links.groupBy("thread").agg(F.countDistinct("page_no").alias("pages"), F.count_if(F.col("status") == "copied").alias("copied"), F.count_if(F.col("status") == "missing").alias("missing"), F.countDistinct("sha256").alias("unique_images"))


def image_manifest(links: DataFrame) -> DataFrame:
    """One row for each content that was copied: where it was first seen, by thread, page, post and place in it. links are
    those of link_manifest, with position, the order of threads, if there is one."""
    order = [c for c in ("position", "thread", "page_no", "place", "image_index") if c in links.columns]
    first = links.where("status = 'copied'").groupBy("sha256").agg(F.min(F.struct(*order, "image_url")).alias("f"), F.count(F.lit(1)).alias("links"))
    return first.select("sha256", F.col("f.thread").alias("first_thread"), F.col("f.page_no").alias("first_page"), F.col("f.image_url").alias("first_image_url"), "links")


def text_exports(threads: DataFrame, exports: DataFrame) -> DataFrame:
    """threads (title, ...) with path: of exports (name without ending, path) the one with the title's safe file name, else
    the first with the same normalised name; null if there is none."""
    named = exports.groupBy(F.col("name").alias("_file")).agg(F.min("path").alias("_exact"))
    alike = exports.select(squeezed(nfkc(F.col("name"))).alias("_key"), "path").where("_key <> ''").groupBy("_key").agg(F.min("path").alias("_alike"))
    rows = threads.withColumns({"_file": safe_filename(F.col("title")), "_key": squeezed(nfkc(F.col("title")))})
    return rows.join(named, "_file", "left").join(alike, "_key", "left").withColumn("path", F.coalesce("_exact", "_alike")).drop("_file", "_key", "_exact", "_alike")
