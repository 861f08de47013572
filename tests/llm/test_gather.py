"""What the rounds of near-duplicates write, and what workers hold from batch to batch."""

import pandas as pd
from pyspark.sql import functions as F

from lexigrow.llm import components, near_dedup, quality


def test_gathered_rounds_write_few_files(spark):
    """A checkpoint's files follow its bytes, not the shuffle partitions (each file of Hadoop's local file system starts two processes)."""
    from pathlib import Path

    from lexigrow.llm.common import ensure_checkpoint_dir, gather

    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    ensure_checkpoint_dir(spark)
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    files = lambda: len([*top.glob("rdd-*/part-*")])
    chains = [(f"{c:03d}-{i:02d}", f"{c:03d}-{i + 1:02d}") for c in range(40) for i in range(8)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        before = files()
        labels = components.components(spark.createDataFrame(chains, "a string, b string"))
        assert {r["key"]: r["label"] for r in labels.collect()} == {k: f"{k[:3]}-00" for pair in chains for k in pair}
        assert files() - before < 48  # one shuffle's partitions; it writes at least three tables
        rows = gather(spark.range(100_000).selectExpr("id % 977 AS k", "id").distinct())
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert rows.count() == 100_000 and rows.agg(F.sum("id")).first()[0] == sum(range(100_000))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_words_of_a_long_text_are_not_kept():
    many = " ".join(f"w{i}" for i in range(near_dedup.MEMO + 1))
    assert len(near_dedup.shingle_set(many, 3)) == near_dedup.MEMO - 1
    assert len(near_dedup._words) <= near_dedup.MEMO


def test_quality_stage_scores_in_parts(spark, monkeypatch):
    """The stage's batches are as long as Arrow's; no more than 500 texts' lines are held at a time, and scores do not change."""
    texts = [f"line {i}\n{'!! ' * (i % 7)}second line, with words." if i % 5 else None for i in range(1203)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    sizes, stage = [], {}
    real = quality.document_scores
    monkeypatch.setattr(quality, "document_scores", lambda m, t: (sizes.append(len(t)), real(m, t))[1])
    monkeypatch.setattr(quality.F, "pandas_udf", lambda kind: lambda f: stage.setdefault("f", f) and (lambda c: F.lit(1.0)))
    quality.quality_stage(df, labels)
    model = quality.fit_quality(df, quality.training_rows(labels))
    got = stage["f"](pd.Series(texts))
    assert sizes == [500, 500, 203] and got.tolist() == real(model, texts).tolist()
    assert stage["f"](pd.Series([], dtype=object)).tolist() == []
