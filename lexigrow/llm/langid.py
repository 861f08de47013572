"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, labels every byte
position with a distribution over the learned languages, and a document's
probabilities are the mean over all its positions.  A long text is read in
windows, each with ``HALO`` bytes of its neighbours on both sides, so that memory
is bounded whatever a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import nn
from .common import crc_fold

HIDDEN, SYMBOLS, EDGE = 6, 258, 256
#: Bytes that a window labels, bytes beside them that it reads as well, and byte positions read at a time.
CORE, HALO, HELD = 480, 16, 600_000
LETTER = re.compile(r"[^\W\d_]")


def windows(text: bytes) -> Iterator[tuple[np.ndarray, int, int]]:
    """(symbols, first, last): the text between two edge symbols in windows; those from first to before last are labelled here."""
    s = np.empty(len(text) + 2, np.int64)
    s[0] = s[-1] = EDGE
    s[1:-1] = np.frombuffer(text, np.uint8)
    for a in range(1, len(text) + 1, CORE):
        z = min(a + CORE, len(text) + 1)
        lo, hi = max(0, a - HALO), min(len(s), z + HALO)
        yield s[lo:hi], a - lo, z - lo


def label_sums(p: dict[str, np.ndarray], parts: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """Label distributions summed over the labelled positions of each window [windows, languages]."""
    out = np.zeros((len(parts), p["c"].shape[0]))
    order = sorted(range(len(parts)), key=lambda i: len(parts[i][0]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(parts[order[at + n]][0]) <= HELD:
            n += 1
        ids = order[at : at + n]
        steps = len(parts[ids[-1]][0])
        x = np.full((steps, n), SYMBOLS - 1, np.int64)
        inside = np.zeros((steps, n), np.float32)
        for j, i in enumerate(ids):
            s, a, z = parts[i]
            x[: len(s), j] = s
            inside[a:z, j] = 1
        size = p["hf"].shape[0]
        states = np.empty((steps, 2 * size, n), np.float32)
        nn.gru_states(x, p["xf"], p["hf"], states[:, :size])
        nn.gru_states(x[::-1], p["xb"], p["hb"], states[::-1, size:])
        total, w, c = np.zeros((p["c"].shape[0], n), np.float32), np.ascontiguousarray(p["o"].T), p["c"][:, None]
        for t in range(0, steps, 8):
            e = np.matmul(w, states[t : t + 8])
            e += c
            e -= e.max(1, keepdims=True)
            np.exp(e, out=e)
            e *= (inside[t : t + 8] / e.sum(1))[:, None, :]
            total += e.sum(0)
        out[ids] = total.T
        at += n
    return out


def train(texts: list[str], langs: list[str], seed: int = 11, steps: int = 240, batch: int = 128, length: int = 64) -> tuple[list[str], dict[str, np.ndarray]]:
    """Learned languages, sorted, and weights, by backpropagation through windows of ``length`` bytes; every language weighs the same."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    p = nn.init_recurrent(rng, SYMBOLS, HIDDEN, 3, max(1, len(names)))
    pools = [(k, own) for k, name in enumerate(names) if (own := [b for t, lang in zip(texts, langs) if lang == name and (b := t.encode("utf-8", "surrogatepass").strip())])]
    if len(pools) < 2:
        return names, p
    opt = nn.Adam(p, 0.02)
    for step in range(steps):
        x, y = np.full((length, batch), SYMBOLS - 1, np.int64), np.zeros(batch, np.int64)
        for j in range(batch):
            k, own = pools[j % len(pools)]
            text = own[rng.integers(len(own))]
            s = np.concatenate([[EDGE], np.frombuffer(text, np.uint8), [EDGE]])
            a = int(rng.integers(0, max(1, len(s) - length + 1)))
            part = s[a : a + length]
            x[: len(part), j], y[j] = part, k
        inside = (x < EDGE).astype(np.float32)
        opt.rate = 0.02 * (1 - 0.9 * step / steps)

        def loss(e):
            d = np.exp(e - e.max(2, keepdims=True))
            d /= d.sum(2, keepdims=True)
            d[:, np.arange(batch), y] -= 1
            return (d * (inside / (np.maximum(inside.sum(0), 1) * batch))[:, :, None]).astype(np.float32), {}

        opt.update(nn.emissions_grad(p, x, loss))
    return names, p


class Labeller:
    def __init__(self, names: list[str], p: dict[str, np.ndarray]) -> None:
        self.names, self.p = names, p

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and pooled probabilities; ``und`` and 0 for a text without letters, or if nothing was learnt."""
        known = [isinstance(t, str) and bool(self.names) and bool(LETTER.search(t)) for t in texts]
        total = np.zeros((len(texts), max(1, len(self.names))))
        parts, owner, held = [], [], 0
        for i, t in enumerate(texts):
            if known[i]:
                for w in windows(t.encode("utf-8", "surrogatepass")):
                    parts.append(w)
                    owner.append(i)
                    held += len(w[0])
                    if held >= 8 * HELD:
                        np.add.at(total, owner, label_sums(self.p, parts))
                        parts, owner, held = [], [], 0
        if parts:
            np.add.at(total, owner, label_sums(self.p, parts))
        best = total.argmax(1)
        share = total[np.arange(len(texts)), best] / np.maximum(total.sum(1), 1e-12)
        return [self.names[k] if ok else "und" for k, ok in zip(best, known)], [min(1.0, float(s)) if ok else 0.0 for s, ok in zip(share, known)]


def fit_language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 200) -> tuple[list[str], dict[str, np.ndarray]]:
    """Fit on at most ``train_docs`` labelled rows of each language, those of least ``xxhash64`` of the id.

    Ids are picked first, without texts: by language those under a hash that
    twice as many should pass, and of these the least.  Rows without an id, a text
    or a language teach nothing.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    size = ids.groupBy("l").agg(F.count("*").alias("n"))  # a row per language
    place = (F.col("h") / F.lit(2.0**64)) + 0.5
    few = ids.join(F.broadcast(size), "l").where(place <= F.lit(2.0 * train_docs + 50) / F.col("n")).select("_id", "l", "h").distinct()
    picked = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "_id"))).where(F.col("r") <= train_docs).select("_id", "l", "h", "r")
    # at most train_docs ids a language; a repeated id stands for its rows, of which as many in all are read
    taught = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).join(F.broadcast(picked), ["_id", "l"])
    found = taught.groupBy("l", "_id", "h").agg(F.min("t").alias("t")).orderBy("l", "h", "_id").select("t", "l").collect()
    return train([r["t"] for r in found], [r["l"] for r in found])


def identify(df: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, predicted language, pooled probability.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learnt.  Ties go to the alphabetically first language.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(*model)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                langs, scores = labeller.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": langs, "score": scores})

    kind = dict(df.dtypes)[id_col]
    fold = crc_fold(F.col(id_col), 4) == 2
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), fold.alias("held_out")).mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_query(df: DataFrame) -> DataFrame:
    """Learned from the rows whose id's crc32 modulo 4 isn't 2, applied to all; null ids count as the text ``''``, repeated rows get the same label each."""
    return identify(df, fit_language_model(df.where(crc_fold(F.col("doc_id"), 4) != 2)))
