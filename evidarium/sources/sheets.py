"""Sheets exported as CSV: tables under a header that must be found, positional ones, and mark matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean


def raw(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Every line as cells c0.. with its place; one file is one partition, so places follow the lines."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    df = spark.read.schema(schema).csv(path, header=False, multiLine=True, escape='"', mode="PERMISSIVE")
    return df.withColumn("line", F.monotonically_increasing_id())


def width_of(spark: SparkSession, path: str) -> int:
    """Cells of the widest row. What stands in quotes is left out before separators are counted, as it may hold separators
    and line ends. A sheet is read as one text, as its rows cannot be told apart otherwise."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    cells = F.transform(F.split(bare, "\n"), lambda row: F.length(row) - F.length(F.replace(row, F.lit(","), F.lit(""))) + 1)
    return spark.read.text(path, wholetext=True).agg(F.max(F.array_max(cells))).first()[0] or 1


def with_header(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows below the first line whose lower-cased cells hold all required names; columns by that line, unnamed ones as
    col0, col1... as far as any line has cells; columns in which no line has any are left out. Only the header line and
    a flag per column go to the driver."""
    width = width_of(spark, path)
    cells = raw(spark, path, width)
    filled = cells.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(width)]).first()
    width = max([i + 1 for i in range(width) if filled[i]], default=1)
    cells = cells.select("line", *[f"c{i}" for i in range(width)])
    names = [f"c{i}" for i in range(width)]
    low = F.array(*[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in names])
    fits = reduce(lambda a, b: a & b, [F.array_contains(low, r.lower()) for r in required])
    head = cells.where(fits).select("line", low.alias("names")).orderBy("line").head()
    if head is None:
        raise ValueError(f"no line of {path} names {required}")
    titles, seen = [], set()
    for i, n in enumerate(head["names"]):
        n = n if n and n not in seen else f"col{i}"
        seen.add(n)
        titles.append(n)
    return cells.where(F.col("line") > head["line"]).select("line", *[clean(F.col(c)).alias(n) for c, n in zip(names, titles)])


def positional(spark: SparkSession, path: str, columns: list[str], skip: int = 1) -> DataFrame:
    cells = raw(spark, path, len(columns))
    return cells.where(F.col("line") >= skip).select("line", *[clean(F.col(f"c{i}")).alias(n) for i, n in enumerate(columns)])


def donor_matrix(spark: SparkSession, path: str, fixed: list[str], models: list[str]) -> DataFrame:
    """One row per mark: the fixed columns, model and mark; blank cells give none."""
    cells = positional(spark, path, fixed + models)
    return cells.unpivot(["line", *fixed], models, "model", "mark").where("mark is not null")


def load_parts(kits: DataFrame, references: DataFrame, sheet: DataFrame, reference: str, part: str) -> DataFrame:
    """Sheet rows with the kit that their reference number names (kit_id), and status: matched or no_kit."""
    ids = references.where("system = 'sheet'").groupBy("value").agg(F.min("kit_id").alias("kit_id"))
    out = sheet.join(ids.withColumnRenamed("value", reference), reference, "left").where(F.col(part).isNotNull())
    known = kits.select(F.col("id").alias("kit_id"), "brand", "name")
    return out.join(known, "kit_id", "left").withColumn("status", F.when(F.col("brand").isNull(), "no_kit").otherwise("matched"))
