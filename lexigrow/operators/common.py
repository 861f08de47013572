"""Lineage cuts and ordering helpers."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED_SCORE = sys.float_info.max
LABELS = ("positive", "negative", "neutral")
#: Rows of names and numbers that an executor can hold beside its work.
BROADCAST_ROWS = 500_000


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder that ``spark.checkpoint.dir`` names; a folder of its own only on one machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexigrow-"))
    return forget(df.checkpoint(eager=True))


def forget(df: DataFrame) -> DataFrame:
    """The same rows without the estimates that a checkpoint takes over from its plan.

    A join's estimated size is the product of its sides'; over rounds of joins
    the numbers' digits double, until planning takes longer than the work.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with numbers from 0 without gaps: those within a partition, after the sizes of the partitions before."""
    rows = materialize(rows).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_b"))
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_b")


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """With a hint if it has few rows, which a checkpoint's plan no longer tells."""
    return F.broadcast(df) if df.count() <= most else df


def strongest_first(lexicon: DataFrame) -> DataFrame:
    return lexicon.orderBy(F.abs("score").desc(), "term")


def top(lexicon: DataFrame, n: int | None) -> DataFrame:
    """The n strongest entries, seeds included; None: all."""
    out = strongest_first(lexicon)
    return out if n is None else out.limit(n)


def argmax_abs(rows: DataFrame) -> DataFrame:
    """Of a term's rows the one of greatest absolute score; ties by polarity, then part of speech."""
    best = F.min_by(F.struct("polarity", "score"), F.struct(-F.abs("score"), "polarity", "pos"))
    return rows.groupBy(F.col("form").alias("term")).agg(best.alias("b")).select("term", "b.polarity", "b.score")
