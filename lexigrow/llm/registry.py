"""The queries ``op<N>_<name>`` and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprint, langid, lm_score, mixing, near_dedup, pii, quality, token_count
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_pii": lambda s, d: pii.find_pii(documents(s, d)),
        "op2_near_dedup": lambda s, d: near_dedup.dedup_query(documents(s, d)),
        "op3_mixing": lambda s, d: mixing.mixing_query(documents(s, d)),
        "op4_language": lambda s, d: langid.language_query(documents(s, d)),
        "op5_chat": lambda s, d: chat.chat_query(table(s, d, "conversations")),
        "op6_lm_score": lambda s, d: lm_score.lm_scores(documents(s, d)),
        "op7_quality": lambda s, d: quality.quality_query(documents(s, d), table(s, d, "labels")),
        "op8_decontamination": lambda s, d: decontam.contaminated(documents(s, d), table(s, d, "benchmark")),
        "op9_token_count": lambda s, d: token_count.token_counts(documents(s, d)),
        "op10_fingerprint": lambda s, d: fingerprint.fingerprint_neighbours(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.mixing_sql(), "op5_chat": chat.CHAT_SQL, "op6_lm_score": lm_score.LM_SQL}
