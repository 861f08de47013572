"""Writers of lexicons, annotation differences, trees and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lexicon_lines(lexicon: DataFrame) -> DataFrame:
    """``term TAB polarity TAB score`` with six decimals, the strongest first."""
    order = [F.abs("score").desc(), F.col("term")]
    return lexicon.orderBy(*order).select(F.concat_ws("\t", "term", "polarity", F.format_string("%.6f", "score")).alias("value"))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """Text files whose parts follow each other in order of strength."""
    lexicon_lines(lexicon).write.mode("overwrite").text(path)


def expansion_terms(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Seeds and newly found terms, the seed kept where both have one; neutral ones dropped, scores ascending."""
    new = found.select("term", "polarity", "score").join(seeds.select("term"), "term", "left_anti")
    return seeds.select("term", "polarity", "score").unionByName(new).where("polarity <> 'neutral'").orderBy("score", "term")


def diff_markables(diff: DataFrame) -> DataFrame:
    """(doc_id, id, span, polarity, kind) of ``corpus_diff`` rows, ids numbered afresh within a document."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "sent_id", "start", "end", "class"))
    span = F.when(F.col("start") == F.col("end"), F.concat(F.lit("word_"), F.col("start").cast("string"))).otherwise(F.concat(F.lit("word_"), F.col("start").cast("string"), F.lit("..word_"), F.col("end").cast("string")))
    return diff.select("doc_id", F.concat(F.lit("markable_"), number.cast("string")).alias("id"), span.alias("span"), F.col("class").alias("polarity"), "kind")


def write_diff(diff: DataFrame, path: str) -> None:
    """The differences as XML, a folder for each kind and document."""
    rows = diff_markables(diff)
    attributes = [F.col(c).alias(f"_{c}") for c in ("id", "span", "polarity")]
    rows.select(F.col("kind"), F.col("doc_id"), *attributes).write.mode("overwrite").partitionBy("kind", "doc_id").format("xml").option("rootTag", "markables").option("rowTag", "markable").save(path)


def agreement_markables(markables: DataFrame) -> DataFrame:
    """Markables as they are written for the agreement tools: ids by level, spans as strings."""
    return markables.select("doc", F.regexp_replace("mid", "markable_", F.concat(F.col("level"), F.lit("_"))).alias("id"), T.ids_to_span(F.col("span")).alias("span"), F.col("level").alias("mmax_level"), "attrs")


def conll_lines(words: DataFrame) -> DataFrame:
    """(file, sent_id, place, value): the tab-separated form of ``conll`` rows, features as ``k=v`` joined by bars, ``_`` for none."""
    from .readers import COLUMNS

    fields = [T.features_string(F.col(c)) if c in ("feat", "pfeat") else F.coalesce(F.col(c), F.lit("_")) for c in COLUMNS]
    return words.select("file", "sent_id", "place", F.concat_ws("\t", *fields, F.array_join("extra", "\t")).alias("value") if "extra" not in words.columns else F.concat(F.concat_ws("\t", *fields), F.when(F.size("extra") > 0, F.concat(F.lit("\t"), F.array_join("extra", "\t"))).otherwise("")).alias("value"))


def write_conll(words: DataFrame, path: str) -> None:
    """Sentences in order, an empty line after each."""
    rows = conll_lines(words).groupBy("file", "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda e: e["value"]), "\n").alias("value"))
    rows.orderBy("file", "sent_id").select(F.concat("value", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def labelled_lines(labels: DataFrame, text: str = "text") -> DataFrame:
    return labels.select(F.concat_ws("\t", F.coalesce(text, F.lit("")), "label").alias("value"))


def write_labelled(labels: DataFrame, path: str, text: str = "text") -> None:
    """``line TAB label`` text files."""
    labelled_lines(labels, text).write.mode("overwrite").text(path)


def evaluation_report(per_file: DataFrame, pooled: bool = False) -> DataFrame:
    """(value): fixed-width lines of ``scores`` rows; the means and deviations over files unless ``pooled``."""
    names = [c for c in per_file.columns if c.startswith(("macro", "micro"))]
    if pooled:
        return per_file.select(F.explode(F.array(*[F.format_string("%-10s %8.4f", F.lit(c), F.col(c)) for c in names])).alias("value"))
    one = per_file.agg(*[x for c in names for x in (F.avg(c).alias(c), F.stddev_pop(c).alias(f"{c}_sd"))])
    return one.select(F.explode(F.array(*[F.format_string("%-10s %8.4f +/- %.4f", F.lit(c), F.col(c), F.col(f"{c}_sd")) for c in names])).alias("value"))


def agreement_report(per_file: DataFrame) -> DataFrame:
    """(value): a fixed-width line for each row of ``kappa`` by file and class."""
    return per_file.select(F.format_string("%-24s %-10s %8d %8d %8d %8d %8.4f", *[F.col(c) for c in ("doc_id", "class", "t1", "o1", "t2", "o2", "kappa")]).alias("value"))
