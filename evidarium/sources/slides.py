"""Slides as extracted XML: labels and pictures, label to picture, and label to place in the original."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import centre, crop_fraction, relative, uncropped
from ..functions.text import ordinal, without_date
from ..operators.matching import nearest_picture
from ..operators.rules import STATUS, mapping_quality, status_of_color
from ..operators.windows import base_pictures

POINT = "struct<_x:long,_y:long>"
EXTENT = "struct<_cx:long,_cy:long>"
BOX = f"struct<`a:off`:{POINT},`a:ext`:{EXTENT}>"
SHAPE = (
    f"`p:spPr` struct<`a:xfrm`:{BOX},`a:ln`:struct<`a:solidFill`:struct<`a:srgbClr`:struct<_val:string>>>>,"
    "`p:txBody` struct<`a:p`:array<struct<`a:r`:array<struct<`a:t`:string>>>>>"
)
PICTURE = f"`p:blipFill` struct<`a:blip`:struct<`_r:embed`:string>,`a:srcRect`:struct<_l:string,_r:string,_t:string,_b:string>>, `p:spPr` struct<`a:xfrm`:{BOX}>"


def scan(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+\.xml)$", 1)
    return df.select("*", ordinal(name).alias("slide"), F.monotonically_increasing_id().alias("idx")).where("slide is not null")


def box() -> list:
    at = lambda field: F.coalesce(F.col(f"`p:spPr`.`a:xfrm`.{field}"), F.lit(0)).cast("double")
    return [at("`a:off`._x").alias("x"), at("`a:off`._y").alias("y"), at("`a:ext`._cx").alias("cx"), at("`a:ext`._cy").alias("cy")]


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """slide, idx, text, color and box of every shape with text."""
    runs = F.transform(F.col("`p:txBody`.`a:p`"), lambda p: F.array_join(F.transform(F.coalesce(p["a:r"], F.array().cast("array<struct<`a:t`:string>>")), lambda r: r["a:t"]), ""))
    text = F.trim(F.array_join(runs, "\n"))
    return scan(spark, path, "p:sp", SHAPE).select("slide", "idx", text.alias("text"), F.col("`p:spPr`.`a:ln`.`a:solidFill`.`a:srgbClr`._val").alias("color"), *box()).where("text <> ''")


def read_pictures(spark: SparkSession, path: str, relations: DataFrame) -> DataFrame:
    """slide, idx, media_name, crop and box of every picture; relations: slide, rel_id, media_name."""
    crop = {s: crop_fraction(F.col(f"`p:blipFill`.`a:srcRect`._{s}")) for s in "lrtb"}
    df = scan(spark, path, "p:pic", PICTURE).select("slide", "idx", F.col("`p:blipFill`.`a:blip`.`_r:embed`").alias("rel_id"), *[v.alias(f"crop_{s}") for s, v in crop.items()], *box())
    df = df.withColumns({"area": F.col("cx") * F.col("cy"), "crop_any": F.greatest(*[F.col(f"crop_{s}") for s in "lrtb"]) > 0})
    return df.join(relations, ["slide", "rel_id"])


def titles(shapes: DataFrame) -> DataFrame:
    """The first text of a slide that names a date and a source."""
    noted = shapes.where(F.col("text").contains("Date:") & F.col("text").contains("Source:"))
    return noted.groupBy("slide").agg(without_date(F.min_by("text", "idx")).alias("slide_title"))


def overlay_labels(shapes: DataFrame, pictures: DataFrame, crosswalk: DataFrame, size: tuple[int, int], here: str = "00FF00", elsewhere: str = "FFFF00") -> DataFrame:
    """Labels with the picture they lie on, where in it and in the original they are, and how far that can be trusted.
    crosswalk: media_name, original_name of pictures known by content. Notes with date and source are no labels."""
    labels = shapes.where(~(F.col("text").contains("Date:") & F.col("text").contains("Source:"))).withColumnRenamed("idx", "label_id")
    near = nearest_picture(labels, pictures)
    base = base_pictures(pictures).select("slide", F.col("media_name").alias("base_media"))
    media = pictures.groupBy("slide").agg(F.countDistinct("media_name").alias("media"))
    named = crosswalk.select(F.col("media_name").alias("p_media_name"), "original_name")
    out = near.join(base, "slide", "left").join(media, "slide", "left").join(named, "p_media_name", "left").join(titles(shapes), "slide", "left")
    mx, my = centre(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    rx, ry = relative(mx, F.col("p_x"), F.col("p_cx")), relative(my, F.col("p_y"), F.col("p_cy"))
    return out.select(
        "slide", "label_id", "slide_title", F.col("text").alias("label_text"), status_of_color(F.col("color"), here, elsewhere).alias("label_status"), F.col("p_media_name").alias("assigned_media"), "original_name",
        mapping_quality(F.col("p_media_name"), F.col("original_name"), F.col("base_media"), F.col("media")).alias("mapping_quality"), rx.alias("x_norm_in_assigned"), ry.alias("y_norm_in_assigned"),
        uncropped(rx, F.col("p_crop_l"), F.col("p_crop_r")).alias("projected_x"), uncropped(ry, F.col("p_crop_t"), F.col("p_crop_b")).alias("projected_y"), (mx / size[0]).alias("slide_x_norm"), (my / size[1]).alias("slide_y_norm"),
    )


def slide_table(labels: DataFrame, pictures: DataFrame) -> DataFrame:
    """One row for each slide with labels (slide, label_status, original_name) or pictures (slide, media_name): pictures,
    unique media, whether one medium stands there twice, whether any is known by content, the base picture's medium, and
    labels by status."""
    shown = pictures.groupBy("slide").agg(F.count(F.lit(1)).alias("picture_count"), F.count_distinct("media_name").alias("unique_media_count"))
    base = base_pictures(pictures).select("slide", F.col("media_name").alias("base_media"))
    status = lambda s: F.count_if(F.col("label_status") == s)
    said = labels.groupBy("slide").agg(F.bool_or(F.col("original_name").isNotNull()).alias("any_match"), status(STATUS["here"]).alias("here_labels"), status(STATUS["elsewhere"]).alias("elsewhere_labels"), status(STATUS["other"]).alias("other_labels"))
    out = shown.join(base, "slide", "left").join(said, "slide", "full")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("picture_count", "unique_media_count", "here_labels", "elsewhere_labels", "other_labels")}
    return out.withColumns(zero).withColumns({"any_match": F.coalesce("any_match", F.lit(False)), "same_media_reuse": F.col("unique_media_count") < F.col("picture_count")})


def media_table(labels: DataFrame, pictures: DataFrame) -> DataFrame:
    """One row for each medium: its slides in order, the labels that lie on it (labels: assigned_media), and on how many
    slides it is the base picture."""
    where = pictures.groupBy("media_name").agg(F.array_join(F.array_sort(F.collect_set("slide")), ",").alias("slides"))
    total = labels.where("assigned_media is not null").groupBy(F.col("assigned_media").alias("media_name")).agg(F.count(F.lit(1)).alias("label_total"))
    base = pictures.join(base_pictures(pictures).select("slide", "media_name"), ["slide", "media_name"], "left_semi")
    base = base.groupBy("media_name").agg(F.count(F.lit(1)).alias("base_slide_count"))
    out = where.join(total, "media_name", "left").join(base, "media_name", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("label_total", "base_slide_count")})
