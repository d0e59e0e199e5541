"""Image files: scans, hashes, sizes from headers, duplicates and the canonical file of each content."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IMAGE_EXTENSIONS, file_score, first_filled, hash_like, humanized, image_code, joined, stem
from ..operators.windows import canonical_files


def scan_files(spark: SparkSession, root: str, extensions=IMAGE_EXTENSIONS, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, rel_path, filename, ext, size_bytes, modified, content of files under root with an allowed extension and
    outside the excluded folders. root is a folder's name in any file system, and no pattern; Spark lists no empty files."""
    endings = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    literal = re.sub(r"([\\{}\[\]*?])", r"\\\1", root)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{endings}}}").load(literal)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    above = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    rel = F.when(F.startswith("path", F.lit(above)), F.substr("path", F.lit(len(above) + 1))).otherwise(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    df = df.select("path", rel.alias("rel_path"), name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    df = df.where(F.col("ext").isin(*extensions))
    for skipped in exclude:
        df = df.where(~F.startswith("rel_path", F.lit(skipped.rstrip("/") + "/")))
    return df


def number(content: Column, at: int, size: int, little: bool) -> Column:
    """An unsigned number at a fixed place of the bytes (from 1)."""
    digits = F.hex(F.substring(content, at, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("int")


def fixed_size(content: Column) -> Column:
    """Struct width, height by headers with fixed places: PNG, GIF, BMP, WEBP; else null."""
    head = F.hex(F.substring(content, 1, 16))
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    low14 = lambda at, size: number(content, at, size, True).bitwiseAND(F.lit(0x3FFF))
    bits = number(content, 22, 4, True)
    long_bits = F.conv(F.concat(*[F.hex(F.substring(content, 25 - i, 1)) for i in range(4)]), 16, 10).cast("long")
    return (
        F.when(head.startswith("89504E470D0A1A0A") & (F.octet_length(content) >= 24), pair(number(content, 17, 4, False), number(content, 21, 4, False)))
        .when(head.startswith("47494638") & (F.octet_length(content) >= 10), pair(number(content, 7, 2, True), number(content, 9, 2, True)))
        .when(head.startswith("424D") & (F.octet_length(content) >= 26), pair(number(content, 19, 4, True), number(content, 23, 4, True)))
        .when(head.rlike("^52494646.{8}57454250") & (F.hex(F.substring(content, 13, 4)) == "56503820") & (F.octet_length(content) >= 30), pair(low14(27, 2), low14(29, 2)))
        .when(head.rlike("^52494646.{8}57454250") & (F.hex(F.substring(content, 13, 4)) == "56503858") & (F.octet_length(content) >= 30), pair(number(content, 25, 3, True) + 1, number(content, 28, 3, True) + 1))
        .when(head.rlike("^52494646.{8}57454250") & (F.hex(F.substring(content, 13, 4)) == "5650384C") & (F.octet_length(content) >= 25), pair((long_bits.bitwiseAND(F.lit(0x3FFF)) + 1).cast("int"), (F.shiftright(long_bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1).cast("int")))
    )


Reader = Callable[[int, int], bytes]


def jpeg_size(read: Reader) -> tuple[int, int] | None:
    """Width and height from the frame header, which stands behind segments of any length."""
    at = 2
    while len(head := read(at, 9)) == 9 and head[0] == 0xFF:
        kind = head[1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[7:9], "big"), int.from_bytes(head[5:7], "big")
        at += 1 if kind == 0xFF else 2 if 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(head[2:4], "big")
    return None


def tiff_size(read: Reader) -> tuple[int, int] | None:
    """Width and height from the first directory, which may stand anywhere; also of files with 64-bit places."""
    head = read(0, 16)
    order = {b"II": "little", b"MM": "big"}[head[:2]]
    num = lambda raw: int.from_bytes(raw, order)
    wide = num(head[2:4]) == 43
    place, count, entry = (8, 8, 20) if wide else (4, 2, 12)
    at, found = num(head[place : 2 * place]), {}
    for i in range(num(read(at, count))):
        raw = read(at + count + entry * i, entry)
        if len(raw) < entry:
            break
        if num(raw[:2]) in (256, 257):
            size = {1: 1, 3: 2, 4: 4, 16: 8}.get(num(raw[2:4]), 4)
            found[num(raw[:2])] = num(raw[entry - place : entry - place + size])
    return (found[256], found[257]) if len(found) == 2 else None


def marker_size(read: Reader) -> tuple[int, int] | None:
    """Width and height of a JPEG or TIFF; None where the bytes end or make no sense."""
    head = read(0, 4)
    if head[:2] == b"\xff\xd8":
        return jpeg_size(read)
    return tiff_size(read) if head in (b"II*\x00", b"MM\x00*", b"II+\x00", b"MM\x00+") else None


#: What is read at a time.
BLOCK = 4096


def reader(source, size: int) -> Reader:
    """Bytes at a place of an open file, through the block that was read last."""
    start, block = 0, b""

    def read(at: int, n: int) -> bytes:
        nonlocal start, block
        if not start <= at or at + n > start + len(block):
            if at >= size:
                return b""
            start, block = at, source.read_at(min(max(n, BLOCK), size - at), at)
        return block[at - start : at - start + n]

    return read


def size_at(path: Column) -> Column:
    """Struct width, height of the JPEG or TIFF at a path, read by a worker at the few places that tell; null for a null path
    and for what is neither. Nothing of the file but these places is read, however long it is."""
    from pyspark.sql.pandas.functions import arrow_udf

    def look(paths: pa.Array) -> pa.Array:
        found = []
        for p in paths.to_pylist():
            if p is None:
                found.append(None)
                continue
            system, name = (fs.LocalFileSystem(), re.sub("^file:/*", "/", p)) if p.startswith(("file:", "/")) else fs.FileSystem.from_uri(quote(p, safe=":/"))
            with system.open_input_file(name) as source:
                found.append(marker_size(reader(source, source.size())))
        limit = 2**31
        kept = [g if g and max(g) < limit else None for g in found]
        return pa.array([g and {"width": g[0], "height": g[1]} for g in kept], pa.struct([("width", pa.int32()), ("height", pa.int32())]))

    return arrow_udf(look, "width int, height int")(path)


def with_sizes(files: DataFrame) -> DataFrame:
    """files with width and height. Sizes with fixed places are read from the content here, if there is any; for JPEG and TIFF
    a worker is sent the path, never the content, and looks for itself. files without content have all JPEG and TIFF sizes,
    and no others; where a file is longer than Spark can hold in a row, drop content before."""
    marked = F.col("ext").isin(".jpg", ".jpeg", ".tif", ".tiff")
    easy = fixed_size(F.col("content")) if "content" in files.columns else F.lit(None).cast("struct<width: int, height: int>")
    sized = files.withColumn("_easy", easy).withColumn("_far", size_at(F.when(F.col("_easy").isNull() & marked, F.col("path"))))
    return sized.select(*files.columns, F.coalesce("_easy.width", "_far.width").alias("width"), F.coalesce("_easy.height", "_far.height").alias("height"))


def inventory(files: DataFrame, hidden: Column | None = None, terms: tuple[str, ...] = ()) -> DataFrame:
    """files with sha256, copies of each content, whether this is the canonical file, and that file's path. terms: words
    that make a file name better than another."""
    df = files.withColumns({"sha256": F.sha2("content", 256), "is_hidden": F.coalesce(hidden if hidden is not None else F.col("filename").startswith("."), F.lit(False))}).drop("content")
    best = canonical_files(df, file_score(F.col("filename"), terms)).select("sha256", F.col("rel_path").alias("canonical_rel_path"))
    counts = df.groupBy("sha256").agg(F.count(F.lit(1)).alias("duplicate_count"))
    out = df.join(counts, "sha256").join(best, "sha256")
    return out.withColumn("is_canonical", F.col("rel_path") == F.col("canonical_rel_path"))


def suggested_title(subject: Column, *details: Column) -> Column:
    """The subject, then a collection and a detail where there are any."""
    return joined(" - ", subject, *details)


def load_ready(inventoried: DataFrame, subject: Column, collection: Column | None = None) -> DataFrame:
    """Canonical files with a code and a suggested title: subject, collection, and the file's name unless it is a hash."""
    canonical = inventoried.where("is_canonical")
    detail = F.when(~hash_like(F.col("filename")), humanized(stem(F.col("filename"))))
    title = suggested_title(subject, collection if collection is not None else F.lit(None), detail)
    return canonical.select("sha256", "rel_path", "filename", "size_bytes", "duplicate_count", image_code("REF-", F.col("sha256"), 16).alias("suggested_image_code"), first_filled(title, F.col("filename")).alias("suggested_title"))
