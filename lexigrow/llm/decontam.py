"""Benchmark decontamination by the q-gram lemma.

A benchmark passage of m characters that a text repeats with at most k edits
leaves at least ``m + 1 - (k + 1) q`` of its q-grams unharmed, on k + 1
neighbouring diagonals.  So: hash every q-gram of the whole text, look up which
are the benchmark's, count the hits in overlapping diagonal bands of 2 (k + 1)
diagonals, keep bands that reach the bound, and verify them by banded
alignment.  Items longer than ``SEGMENT`` characters are also matched by
overlapping segments, so that long parts of an item count.  Items shorter than
two q-grams have no such bound: they count where they stand unharmed between
word boundaries.  Characters are compared with A-Z lower-cased and every ASCII
blank alike.

A text's hits are taken in overlapping slices of bounded number, so that a
repetitive text that meets a repetitive item costs time in proportion to both,
and no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS

Q, ERRORS, SEGMENT, STEP = 8, 0.1, 160, 80
#: Items are taken in blocks of about so many characters; each block is one pass over the texts.
BLOCK_CHARS = 1_000_000
TABLE_BITS = 22
#: Pairs of a text's and an item's q-gram that are held at a time, and the characters by which slices overlap.
HELD_HITS, OVERLAP = 500_000, 4 * SEGMENT


_FOLD = np.arange(1 << 16, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_P1, _P2, _P4, _PH = (np.uint32(x) for x in (0x01000193, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


def codes(text: str) -> np.ndarray:
    """Code points modulo 2 ** 16, folded."""
    return _FOLD[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint16)[::2]]


_PLAIN = {**{k: k + 32 for k in range(65, 91)}, **{k: 32 for k in range(9, 14)}}


def folded(text: str) -> str:
    return text.translate(_PLAIN)


def find_short(short: list, text: str) -> dict:
    """By item: (0, start, end) of its first place between word boundaries."""
    out, plain = {}, folded(text)
    for item, part in short:
        at = plain.find(part)
        while at >= 0:
            end = at + len(part)
            if not (at and plain[at - 1].isalnum() and part[0].isalnum()) and not (plain[end : end + 1].isalnum() and part[-1].isalnum()):
                out[item] = (0, at, end)
                break
            at = plain.find(part, at + 1)
    return out


def grams(c: np.ndarray) -> np.ndarray:
    """32-bit hashes of all q-grams, by doubling; a chance hit is sorted out by the alignment."""
    if len(c) < Q:
        return np.zeros(0, np.uint32)
    h = c[:-1] * _P1 + c[1:]
    h = h[:-2] * _P2 + h[2:]
    h = h[:-4] * _P4 + h[4:]
    return (h ^ (h >> np.uint32(15))) * _PH


def budget(m: int) -> int:
    """Edits allowed in m characters: a tenth, but few enough for the lemma's bound to be at least 2."""
    return max(0, min(int(m * ERRORS), (m - 1) // Q - 1))


def bound(m: int) -> int:
    return m + 1 - (budget(m) + 1) * Q


@dataclass
class Index:
    items: list  # of each segment: the item's id
    segments: list[np.ndarray]
    hashes: np.ndarray  # sorted
    segment: np.ndarray  # by hash
    position: np.ndarray
    table: np.ndarray  # which of 2 ** TABLE_BITS hash prefixes occur

    least: int  # the least bound of a segment
    reach: int  # how far apart its hits can stand
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray
    short: list  # (item's id, folded text) of items too short for the lemma


def build(items: list[tuple[int, str]]) -> Index | None:
    """None if no item has any characters."""
    ids, segments, short = [], [], []
    for item, text in items:
        c = codes(text.strip()) if isinstance(text, str) else np.zeros(0, np.uint32)
        if not len(c):
            continue
        if len(c) < 2 * Q:
            short.append((item, folded(text.strip())))
            continue
        starts = [0] if len(c) <= SEGMENT else [*range(0, len(c) - SEGMENT, STEP), len(c) - SEGMENT]
        for a in starts:
            ids.append(item)
            segments.append(c[a : a + SEGMENT])
    if not segments:
        none = np.zeros(0, np.int64)
        return Index([], [], none, none, none, np.zeros(1 << TABLE_BITS, bool), 1, 1, none, none, none, short) if short else None
    sizes = [len(s) for s in segments]
    h = [grams(s) for s in segments]
    hashes, segment = np.concatenate(h), np.repeat(np.arange(len(h)), [len(x) for x in h])
    position = np.concatenate([np.arange(len(x)) for x in h])
    order = np.argsort(hashes, kind="stable")
    table = np.zeros(1 << TABLE_BITS, bool)
    table[hashes >> np.uint32(32 - TABLE_BITS)] = True
    return Index(ids, segments, hashes[order], segment[order].astype(np.int32), position[order].astype(np.int32), table, min(map(bound, sizes)), max(m + budget(m) for m in sizes), np.array(sizes), np.array([*map(budget, sizes)]), np.array([*map(bound, sizes)]), short)


def banded_distance(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int]:
    """Least edits (k + 1 if over k) that turn the item into a part of the region; that part's bounds.

    The table has a row per item character; within a row, insertions are resolved by a running minimum.
    """
    n = len(region)
    whole, part = region.tobytes(), item.tobytes()
    at = whole.find(part)
    while at >= 0 and at % 4:
        at = whole.find(part, at + 1)
    if at >= 0:
        return 0, at // 4, at // 4 + len(item)
    steps = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), steps.copy()
    for i, ch in enumerate(item, 1):
        diag, up = row[:-1] + (region != ch), row[1:] + 1
        take = diag <= up
        best = np.concatenate([[i], np.where(take, diag, up)])
        begin = np.concatenate([[0], np.where(take, start[:-1], start[1:])])
        key = best - steps
        low = np.minimum.accumulate(key)
        where = np.maximum.accumulate(np.where(key == low, steps, 0))
        row, start = low + steps, begin[where]
        if row.min() > k:
            return k + 1, 0, 0
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def find(index: Index, text: str) -> dict:
    """By item: (edits, start, end) of its best match in the text."""
    out = find_short(index.short, text) if index.short else {}
    c = codes(text)
    h = grams(c)
    if not len(h) or not index.items:
        return out
    hit = np.flatnonzero(index.table[h >> np.uint32(32 - TABLE_BITS)])
    least = index.least
    if len(hit) < least:
        return out
    # hits that stand too thin for any segment's bound
    dense = hit[least - 1 :] - hit[: len(hit) - least + 1] <= index.reach
    cover = np.zeros(len(hit) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(dense), 1)
    np.add.at(cover, np.flatnonzero(dense) + least, -1)
    hit = hit[np.cumsum(cover[:-1]) > 0]
    if not len(hit):
        return out
    lo, hi = np.searchsorted(index.hashes, h[hit], "left"), np.searchsorted(index.hashes, h[hit], "right")
    times = hi - lo
    hit, lo, times = hit[times > 0], lo[times > 0], times[times > 0]
    total, first = np.cumsum(times), 0
    while first < len(hit):
        # so many hits, but at least twice what neighbouring slices share
        last = max(int(np.searchsorted(total, total[first] + HELD_HITS)), int(np.searchsorted(hit, hit[first] + 2 * OVERLAP)))
        last = min(max(last, first + 1), len(hit))
        find_slice(index, c, hit[first:last], lo[first:last], times[first:last], out)
        if last == len(hit):
            break
        first = max(first + 1, int(np.searchsorted(hit, hit[last] - OVERLAP)))
    return out


def find_slice(index: Index, c: np.ndarray, hit: np.ndarray, lo: np.ndarray, times: np.ndarray, out: dict) -> None:
    """Enter into ``out`` what the hits at the positions ``hit``, ``times`` from ``lo`` in the index, amount to."""
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    where = np.repeat(hit, times)
    seg, diagonal = index.segment[at].astype(np.int64), where - index.position[at]
    sizes, k, need = index.sizes, index.budgets, index.bounds
    width = k[seg] + 1
    band = (diagonal + SEGMENT) // width
    # each hit counts in its own band and the one before: bands of twice the width, each begun at every width
    key = np.concatenate([seg * (1 << 40) + band, seg * (1 << 40) + np.maximum(band - 1, 0)])
    bands, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    enough = counts >= need[bands >> 40]
    if not enough.any():
        return
    # of those, count each position of the segment once: repetitive texts hit one position over and over
    held = enough[inverse]
    single = np.unique(inverse[held] * np.int64(1 << 16) + np.tile(index.position[at], 2)[held]) >> 16
    counts = np.bincount(single, minlength=len(bands))
    for b in bands[counts >= need[bands >> 40]]:
        s = int(b >> 40)
        first = int(b & ((1 << 40) - 1)) * int(k[s] + 1) - SEGMENT
        a, z = max(0, first - int(k[s])), min(len(c), first + 2 * int(k[s] + 1) + int(sizes[s]) + int(k[s]))
        best = out.get(index.items[s])
        if best is not None and best[0] == 0 and best[1] <= a:
            continue  # nothing further on can be better
        edits, u, v = banded_distance(index.segments[s], c[a:z], int(k[s]))
        if edits <= k[s]:
            found = (edits, a + u, a + v)
            out[index.items[s]] = min(out.get(index.items[s], found), found)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[Index]:
    """The benchmark's indexes, one for about BLOCK_CHARS characters each."""
    b = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    chars = b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-chars // BLOCK_CHARS))
    out = []
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("i", "t").collect()
        if index := build([(r["i"], r["t"]) for r in rows]):
            out.append(index)
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, edits, start, end): a row for each row of ``df`` and item found in its text.

    ``start`` and ``end`` bound the best match in code points.  Null and empty
    texts hold nothing; null and blank items are found nowhere; an item that comes
    twice under one id counts once for a row.
    """
    kind, item = dict(df.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kind}, item_id {item}, edits int, start int, end int"
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark = df.sparkSession
    out = None
    for index in blocks(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast(index)  # of bounded size: BLOCK_CHARS

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, i, *m) for d, t in zip(batch["doc_id"], batch["text"]) if isinstance(t, str) for i, m in find(shared.value, t).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start", "end"])

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontam_stage(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark passage; null and empty texts stay, and so do repeated rows that are clean."""
    spark, out = df.sparkSession, df.select(*DOCUMENT_COLUMNS)
    for index in blocks(benchmark, "item_id", "text"):
        out = out.where(_clean(spark.sparkContext.broadcast(index))("text"))
    return out


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not (isinstance(t, str) and find(shared.value, t)) for t in texts], dtype=bool)

    return clean
