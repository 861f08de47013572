"""Quality classifier: a linear-chain CRF labels every line good or bad.

Each line's features are discretised surface statistics of the line and of its
neighbours.  The chain is trained in numpy on labelled documents, whose lines
inherit the document's label; a document's score is the mean over its lines,
weighted by length, of the forward-backward marginal of "good".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nn
from .common import DOCUMENT_COLUMNS, crc_fold

#: Upper edges of the bins of each statistic; a bin is one indicator.
EDGES = {
    "length": (10, 30, 80, 200, 600),
    "symbols": (0.0, 0.02, 0.06, 0.12, 0.25),
    "upper": (0.02, 0.08, 0.3, 0.7),
    "repeat": (0.0, 0.1, 0.3, 0.6, 0.85),
    "same_next": (0.0, 0.1, 0.4, 0.8),
    "digits": (0.0, 0.05, 0.3),
    "bars": (0.0, 0.02, 0.2, 0.45),
    "bangs": (0.0, 0.02, 0.2),
    "stops": (0.0, 0.05, 0.15),
    "word_len": (2.5, 4.0, 7.0, 12.0),
}
SIZES = [len(e) + 1 for e in EDGES.values()]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
OWN = int(sum(SIZES))
#: own bins, the previous and the next line's bins, first line, last line, bias
FEATURES = 3 * OWN + 3
SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")


def statistics(line: str) -> tuple[float, ...]:
    n = max(1, len(line))
    words = line.split()
    k = max(1, len(words))
    same = sum(map(str.__eq__, words, words[1:])) if k > 1 else 0
    stops = line.count(". ") + line.count(", ") + line.endswith(".")
    return (len(line), len(SYMBOL.findall(line)) / n, len(UPPER.findall(line)) / n, 1 - len(set(words)) / k if words else 0.0, same / max(1, k - 1), len(DIGIT.findall(line)) / n, line.count("|") / k, line.count("!!") / k, stops / k, n / k)


def line_bins(lines: list[str]) -> np.ndarray:
    """Active own indicators [lines, statistics]."""
    s = np.array([statistics(x) for x in lines], np.float64).reshape(len(lines), len(EDGES))
    return np.stack([np.searchsorted(np.array(e), s[:, i], side="left") + OFFSETS[i] for i, e in enumerate(EDGES.values())], 1)


def document_lines(text: str | None) -> list[str]:
    """Lines with something in them; an empty text is one empty line."""
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


def active(bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Active features [lines, 3 * statistics + 2]; at a document's ends the neighbour is replaced by a flag."""
    n = len(bins)
    before = np.where(first[:, None], 3 * OWN, np.roll(bins, 1, 0) + OWN)
    after = np.where(last[:, None], 3 * OWN + 1, np.roll(bins, -1, 0) + 2 * OWN)
    return np.concatenate([bins, before, after, np.full((n, 1), 3 * OWN + 2)], 1)


def emit(w: np.ndarray, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of "good" against "bad" for all lines, where each document starts, line lengths."""
    counts = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(counts)])
    lines = [x for d in docs for x in d]
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    first[starts[:-1]] = last[starts[1:] - 1] = True
    f = active(line_bins(lines), first, last)
    return w[f].sum(1), starts, np.array([max(1, len(x)) for x in lines], np.float64)


def forward_backward(score: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log alpha and beta [lines, 2], in lock step over the documents from long to short."""
    counts = np.diff(starts)
    order = np.argsort(-counts, kind="stable")
    top = int(counts.max())
    alive = np.searchsorted(-counts[order], -np.arange(1, top + 1), side="right")
    at = starts[order]
    emits = np.stack([np.zeros_like(score), score], 1)
    alpha, beta = np.empty((len(score), 2)), np.zeros((len(score), 2))
    a = emits[at]
    alpha[at] = a
    for t in range(1, top):
        n = alive[t]
        i = at[:n] + t
        a = np.logaddexp(a[:n, 0, None] + trans[0], a[:n, 1, None] + trans[1]) + emits[i]
        alpha[i] = a
    for t in range(top - 2, -1, -1):
        i = at[: alive[t + 1]] + t
        x = emits[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(trans[:, 0] + x[:, 0, None], trans[:, 1] + x[:, 1, None])
    return alpha, beta


def good_marginals(score: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    alpha, beta = forward_backward(score, starts, trans)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))


def train(texts: list[str], labels: list[int], rounds: int = 60, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Full-batch Adam on the chain's log likelihood; both classes weigh the same, and so does each document."""
    w, trans = np.zeros(FEATURES), np.zeros((2, 2))
    if len(set(labels)) < 2:
        if labels:
            w[-1] = 2.0 if labels[0] else -2.0
        return {"w": w, "t": trans}
    docs = [document_lines(t) for t in texts]
    y = np.array(labels)
    counts = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(counts)])
    lines = [x for d in docs for x in d]
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    first[starts[:-1]] = last[starts[1:] - 1] = True
    f = active(line_bins(lines), first, last)
    gold = np.repeat(y, counts)
    weight = np.repeat(0.5 / np.where(y == 1, (y == 1).sum(), (y == 0).sum()) / counts, counts)
    i = np.flatnonzero(~last)
    p = {"w": w, "t": trans}
    opt = nn.Adam(p, 0.15)
    for _ in range(rounds):
        score = w[f].sum(1)
        alpha, beta = forward_backward(score, starts, trans)
        both = alpha + beta
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        d = (good - gold) * weight
        gw = np.bincount(f.ravel(), np.repeat(d, f.shape[1]), FEATURES) + l2 * w / len(EDGES)
        # pair marginals of neighbouring lines against what the labels say
        z = np.logaddexp(both[i, 0], both[i, 1])
        after = np.stack([beta[i + 1, 0], score[i + 1] + beta[i + 1, 1]], 1)
        pair = np.exp(alpha[i][:, :, None] + trans + after[:, None, :] - z[:, None, None])
        pair[np.arange(len(i)), gold[i], gold[i + 1]] -= 1
        gt = (pair * weight[i][:, None, None]).sum(0)
        opt.update({"w": gw, "t": gt + 0.01 * trans})
    return p


def document_scores(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    score, starts, lengths = emit(model["w"], [document_lines(t) for t in texts])
    good = good_marginals(score, starts, model["t"])
    return np.clip(np.add.reduceat(good * lengths, starts[:-1]) / np.add.reduceat(lengths, starts[:-1]), 0, 1)


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = 3000) -> dict[str, np.ndarray]:
    """Fit on at most ``train_docs`` labelled rows, half of them of each class if there are so many.

    The rows are those of least ``xxhash64`` of the id.  Null labels and null texts teach nothing.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    side = marked.withColumn("h", F.xxhash64(F.col("_id").cast("string")))
    picked = side.where("y = 0").orderBy("h", "_id").limit(train_docs // 2).unionByName(side.where("y = 1").orderBy("h", "_id").limit(train_docs // 2))
    # at most train_docs rows: the broadcast has a fixed bound
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "_id").select("t", "y", "h").distinct().orderBy("h", "t").limit(train_docs).collect()
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def score_quality(df: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score in [0, 1], predicted class.  Null texts score as empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                s = document_scores(model, [t if isinstance(t, str) else None for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    kind = dict(df.dtypes)[id_col]
    fold = crc_fold(F.col(id_col), 3) == 1
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), fold.alias("held_out")).mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def training_rows(labels: DataFrame) -> DataFrame:
    return labels.where(crc_fold(F.col("doc_id"), 3) != 1)


def quality_query(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Learned from the labels whose id's crc32 modulo 3 isn't 1, applied to all rows; null texts score as empty ones, repeated rows alike."""
    return score_quality(df, fit_quality(df, training_rows(labels)))


def quality_stage(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` whose score is at least 0.5; columns as they were.  Null texts are judged as empty ones, repeated rows alike."""
    model = fit_quality(df, training_rows(labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        plain = [t if isinstance(t, str) else None for t in texts]
        return pd.Series(np.concatenate([document_scores(model, plain[at : at + 500]) for at in range(0, max(1, len(plain)), 500)]), dtype="float64")

    return df.select(*DOCUMENT_COLUMNS).where(score("text") >= 0.5)
