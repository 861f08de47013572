"""From raw documents to a training mix: reject, deduplicate, decontaminate, redact, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrow.llm.common import documents, materialize
from lexigrow.llm.decontam import decontam_stage
from lexigrow.llm.mixing import mixing_stage
from lexigrow.llm.near_dedup import dedup_stage
from lexigrow.llm.pii import pii_stage
from lexigrow.llm.quality import quality_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_stage(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing_stage(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: Learned, approximate-candidate and fuzzy stages: SQL can't state them.  tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is kept, so that no later stage computes it again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
