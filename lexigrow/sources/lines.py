"""Lines of text files in their order, and what depends on the lines before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPE = "\x1b"
SENTENCE = r"^\s*<\s*sentence\s*/\s*>\s*$"
#: Names a line within all files; sorted by these, a file's lines are in their order.
PLACE = ["file", "block", "row"]


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, block, row, line): ``block`` is the byte at which the split begins, ``row`` rises within it."""
    raw = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return raw.withColumn("row", F.monotonically_increasing_id()).select(*PLACE, "line")


def stripped(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines without blanks at their ends, and without the empty ones."""
    return lines(spark, *paths).withColumn("line", strip("line")).where("line <> ''")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def running(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over a file's lines up to each one.

    Sums run within a block, and over the blocks' totals: no task orders a whole file.
    """
    rows = rows.withColumn("_n", amount)
    blocks = rows.groupBy("file", "block").agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = blocks.select("file", "block", before.alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_w", within).join(start, ["file", "block"]).withColumn(name, F.col("_before") + F.col("_w")).drop("_n", "_w", "_before")


def last_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` of the file up to each line: by block, then over the blocks' last ones."""
    rows = rows.withColumn("_v", value)
    blocks = rows.groupBy("file", "block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("row"))).alias("_l"))
    before = F.last("_l", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    start = blocks.select("file", "block", before.alias("_before"))
    within = F.last("_v", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_w", within).join(start, ["file", "block"]).withColumn(name, F.coalesce("_w", "_before")).drop("_v", "_w", "_before")


def previous(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the line before's ``value``; a file's first line has none."""
    rows = rows.withColumn("_v", value)
    blocks = rows.groupBy("file", "block").agg(F.max_by("_v", "row").alias("_l"))
    start = blocks.select("file", "block", F.lag("_l").over(Window.partitionBy("file").orderBy("block")).alias("_before"))
    at = Window.partitionBy("file", "block").orderBy("row")
    rows = rows.withColumn("_w", F.lag("_v").over(at)).withColumn("_first", F.row_number().over(at) == 1)
    return rows.join(start, ["file", "block"]).withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_w"))).drop("_v", "_w", "_first", "_before")


def field_list(c: str = "line") -> Column:
    return F.split(c, " *\t+ *")
