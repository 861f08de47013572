"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched by registers of exponentially
spaced truncated minima: ``K_i = floor(1 - log_b(min_i))``.  Sketches merge by
the register-wise maximum and are locality-sensitive.  Runs of register values
are hashed into bands; pairs that share a band are estimated jointly by maximum
likelihood where they are many, and every link is confirmed on the full sets.
Equal sets are one node from the start.

With 25 bands of 5 registers a pair at the threshold 0.85 goes unseen with
probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, gather, materialize, mix64
from .components import DOUBT, SURE, link, spanning

M, BANDS, ROWS = 128, 25, 5
BASE, RATE, LIMIT = 1.02, 20.0, 65534
GOLD = np.uint64(0x9E3779B97F4A7C15)
_J = np.arange(M)
#: Bounds of the intervals from which an element's j-th value is drawn.
_GAMMA = np.concatenate([np.log1p(np.arange(M) / (M - np.arange(M))) / RATE, [np.inf]])
_LO = _GAMMA[:-1]
_SPAN = 1 - np.exp(-RATE * (_GAMMA[1:] - _LO))
#: Estimates this far below the threshold are over four standard deviations off.
SLACK = 0.15
#: Words whose hashes a worker keeps from one text to the next.
MEMO = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Hashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes: words between ASCII blanks, A-Z lower-cased."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    h = np.array([_words[w] for w in split], np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * GOLD + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _draw(h: np.ndarray, j) -> tuple[np.ndarray, np.ndarray]:
    """Registers and values of the elements' j-th draws; over all j a register comes once."""
    u = (mix64(h + np.uint64(1) + np.asarray(j).astype(np.uint64) * GOLD) >> np.uint64(11)) * 2.0**-53
    reg = ((h >> np.uint64(8)) + np.asarray(j).astype(np.uint64) * ((h >> np.uint64(16)) | np.uint64(1))) & np.uint64(M - 1)
    return reg.astype(np.int64), _LO[j] - np.log1p(-u * _SPAN[j]) / RATE


def sketch(h: np.ndarray) -> np.ndarray:
    return sketches_of([h])[0]


def sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    """Registers [sets, M]; the sets draw in lock step, and a set stops when no later draw can be its least."""
    low = np.full((len(sets), M), np.inf)
    sizes = np.array([len(s) for s in sets])
    h, row = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    for j in range(M):
        reg, x = _draw(h, j)
        np.minimum.at(low.ravel(), row * M + reg, x)
        if j + 1 < M:
            going = low.max(1) > _LO[j + 1]
            if not (going & (sizes > 0)).any():
                break
            if not going[row].all():
                h, row = h[going[row]], row[going[row]]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low) / np.log(BASE))
    return np.where(np.isfinite(k), np.clip(k + 1024, 0, LIMIT), 0).astype(">u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def set_key(h: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mix64(h).sum(dtype=np.uint64), mix64(h ^ GOLD).sum(dtype=np.uint64)], ">u8").tobytes()


_GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of sketch pairs [pairs, M] with known set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pa, pb = p(u - v * j), p(v - u * j)
    tiny = 1e-300
    score = above[:, None] * np.log(pa + tiny) + below[:, None] * np.log(pb + tiny) + (M - above - below)[:, None] * np.log(np.maximum(1 - pa - pb, tiny))
    return j[np.arange(len(j)), score.argmax(1)]


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether ``estimate`` is at least ``least``: the likelihood, which has one top, still rises there."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    u = na / (na + nb)
    v = 1 - u
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * c) / np.log(BASE)
    slope = lambda x: c / ((1 - x * c) * np.log(BASE))
    x, y = np.maximum(u - v * least, 1e-12), np.maximum(v - u * least, 1e-12)
    pa, pb, da, db = p(x), p(y), -v * slope(x), -u * slope(y)
    rise = above * da / pa + below * db / pb - (M - above - below) * (da + db) / (1 - pa - pb)
    return (rise >= 0) & (np.minimum(u / v, v / u) >= least)


#: A set of more shingles is compared within blocks by a sample of about KEEP / 2 to KEEP of them.
KEEP = 512


def sample(h: np.ndarray, turn: int) -> bytes:
    """32 bits of each shingle, or of those in a hash range whose share halves as the set doubles."""
    x = np.unique((mix64(h + np.uint64(turn) * GOLD) >> np.uint64(32)).astype(np.uint32))
    return x[x < (1 << 32) >> sample_level(len(h))].tobytes()


def sample_level(n):
    return np.ceil(np.log2(np.maximum(n, KEEP) / KEEP)).astype(np.int64)


def common_counts(samples: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared sampled shingles of all pairs of sets, and each set's own, at a sampling level."""
    cut = [x[x < (1 << 32) >> level] for x in samples]
    sizes = np.array([len(x) for x in cut])
    values, column, times = np.unique(np.concatenate(cut), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(cut)), sizes)
    used = times > 1  # shingles of one set alone are in no intersection
    number = np.cumsum(used) - 1
    held = used[column]
    row, column = row[held], number[column[held]]
    both = np.zeros((len(cut), len(cut)), np.float32)
    for at in range(0, int(used.sum()), 4096):
        part = (column >= at) & (column < at + 4096)
        m = np.zeros((len(cut), min(4096, int(used.sum()) - at)), np.float32)
        m[row[part], column[part] - at] = 1
        both += m @ m.T
    return both, sizes


def linking(threshold: float):
    """Picks a spanning forest of the pairs that reach the threshold.

    A pair is looked at in the first band that it shares.  Its likelihood
    estimate must come near the threshold; then the sets are compared, sampled
    ones with the slack of their sampling error.
    """

    def choose(group: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = group["n"].to_numpy(np.float64)
        s = np.stack([np.frombuffer(x, ">u2") for x in group["sketch"]]).astype(np.uint16)
        band = int(group["bucket"].iat[0]) & 31
        powers = np.uint64(65537) ** np.arange(ROWS, dtype=np.uint64)
        keys = (s[:, : BANDS * ROWS].astype(np.uint64).reshape(len(s), BANDS, ROWS) * powers).sum(2).T
        at = np.flatnonzero(np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
        kept = [np.zeros(0, np.int64)]
        for a in range(0, len(at), 20_000):
            part = at[a : a + 20_000]
            # looked at in an earlier band already?
            seen = np.zeros(len(part), bool)
            for earlier in keys[:band]:
                seen |= earlier[i[part]] == earlier[j[part]]
            part = part[~seen]
            if len(part):
                kept.append(part[likely(s[i[part]], s[j[part]], n[i[part]], n[j[part]], threshold - SLACK)])
        at = np.concatenate(kept)
        out = np.zeros(len(i), np.int8)
        if not len(at):
            return out
        samples = [np.frombuffer(x, np.uint32) for x in group["sample"]]
        level = np.maximum(sample_level(n[i[at]]), sample_level(n[j[at]]))
        likeness = np.zeros(len(at))
        slack = np.zeros(len(at))
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            names, at_name = np.unique(np.concatenate([i[at[own]], j[at[own]]]), return_inverse=True)
            both, sizes = common_counts([samples[x] for x in names], int(k))
            p, q = at_name[: len(own)], at_name[len(own) :]
            union = np.maximum(sizes[p] + sizes[q] - both[p, q], 1)
            likeness[own] = both[p, q] / union
            slack[own] = 5 * np.sqrt(threshold * (1 - threshold) / union) if k else 1e-9
        # the surest first; of sampled pairs in doubt all those that the sure ones leave apart
        order = np.argsort(-likeness, kind="stable")
        at, likeness, slack = at[order], likeness[order], slack[order]
        fits = likeness >= threshold - slack
        sure = np.flatnonzero(fits & ((likeness >= threshold + slack) | (slack < 1e-6)))
        label = pd.factorize(group["label"])[0]
        out[at[sure][spanning(label, i[at[sure]], j[at[sure]])]] = SURE
        doubt = np.setdiff1d(np.flatnonzero(fits), sure)
        if len(doubt):
            name = joined_labels(label, i[out > 0], j[out > 0])
            p, q = i[at[doubt]], j[at[doubt]]
            out[at[doubt][name[p] != name[q]]] = DOUBT
        return out

    return choose


def joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    name = label.copy()
    for a, b in zip(i.tolist(), j.tolist()):
        u, v = name[a], name[b]
        if u != v:
            name[name == max(u, v)] = min(u, v)
    return name


def held_together(sets: Iterator[tuple], shingles: int) -> list[tuple]:
    """The next of the (id, set) pairs, until they hold so many shingles."""
    out, n = [], 0
    for pair in sets:
        out.append(pair)
        n += len(pair[1]) + 100
        if n >= shingles:
            break
    return out


def sketches(df: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = ((d, shingle_set(t if isinstance(t, str) else None, words)) for d, t in zip(batch["doc_id"].astype("Int64"), batch["text"]))
            while part := held_together(made, 200_000):
                ids, sets = zip(*part)
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "key": [set_key(s) for s in sets], "n": [len(s) for s in sets], "sketch": [s.tobytes() for s in sketches_of(sets)]})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, key binary, n long, sketch binary")


#: Ids up to this many are broadcast to the scan of texts; more are joined by shuffle.
BROADCAST_IDS = 200_000


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row.

    Rows with similarity of at least ``percent`` / 100 are linked; the component
    is named by its smallest id.  A null or blank text has an empty set, is
    linked with nothing and is kept.  Rows with a null id take part; if all ids
    of a component are null, so is its name, and its rows are kept.  Repeated
    ids are allowed: every row with the component's id is marked kept.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(sketches(df, words, id_col, text_col))
    nodes = gather(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.shiftleft(F.xxhash64(i, F.expr("sketch").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))), 5).bitwiseOR(i))
    buckets = nodes.select("key", F.explode(bands).alias("bucket"))

    def of_keys(keys: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` of the shingle sets of ``keys``, from one text each."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    part = [shingle_set(t, words) for t in batch["text"].iloc[at : at + 500] if isinstance(t, str)]
                    yield pd.DataFrame({"key": [set_key(s) for s in part], "value": [fn(s) for s in part]})

        reps = gather(keys.join(nodes.select("key", "rep"), "key"))
        ids = reps.select(F.col("rep").alias("r")).distinct()
        small = reps.count() <= BROADCAST_IDS
        held = texts.join(F.broadcast(ids) if small else ids, texts.doc_id.eqNullSafe(F.col("r")), "left_semi")
        # a repeated id may bring in texts of other sets; the keys sort them out
        return held.mapInPandas(run, f"key binary, value {schema}").join(reps.select("key"), "key", "left_semi").dropDuplicates(["key"])

    def verify(edges: DataFrame) -> DataFrame:
        used = edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct()
        sets = of_keys(used, lambda s: s.view(np.int64), "array<long>")
        a = sets.select(F.col("key").alias("a"), F.col("value").alias("ha"))
        b = sets.select(F.col("key").alias("b"), F.col("value").alias("hb"))
        both = edges.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
        return both.where(F.col("common") * 100 >= F.lit(percent) * (F.size("ha") + F.size("hb") - F.col("common"))).select("a", "b")

    def enrich(rest: DataFrame, turn: int) -> DataFrame:
        samples = gather(of_keys(rest.select("key").distinct(), lambda s: sample(s, turn), "binary"))
        return rest.join(nodes.select("key", "sketch", "n"), "key").join(samples.withColumnRenamed("value", "sample"), "key")

    labels = link(buckets, verify, enrich, linking(percent / 100))
    named = nodes.select("key", "rep").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    names = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    parts = named.join(names, "label").select("key", "component_id")
    out = rows.select("doc_id", "key", "n").join(parts, "key", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.col("n").eqNullSafe(0) | own.isNull()).alias("kept"))


def dedup_query(df: DataFrame) -> DataFrame:
    """Three words, 0.85, whole texts; nulls, blanks and repeated ids as in ``near_duplicates``."""
    return near_duplicates(df, words=3, percent=85)


def dedup_stage(df: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of near copies (five words, 0.8), that of the smallest id.

    Ids name documents: rows of one id stand or fall together.  Rows without
    words, and groups whose ids are all null, stay as they are.
    """
    d = df.select(*DOCUMENT_COLUMNS)
    lost = near_duplicates(d).where("not kept").select(F.col("doc_id").alias("_lost")).distinct()
    return d.join(lost, F.col("doc_id").eqNullSafe(F.col("_lost")), "left_anti")
