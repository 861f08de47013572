"""Document fingerprints by a randomised edit embedding.

A walk copies a text: at step j it writes the symbol under its pointer and moves
on if a bit shared by all texts, drawn for (j, character), is set.  Texts at a
small edit distance fall into step again soon after an edit, so the Hamming
distance of their embeddings follows the edit distance.  A written symbol is a
byte hashed from the next four characters, so that it rarely agrees by chance.

The fingerprint samples the embedding at the ``SAMPLES`` steps of least shared
priority among a text's steps.  The sample is consistent: of two texts, the
steps that both have are sampled in both.  ``near_pairs`` doesn't sample: it
blocks by q-grams of the whole text so that no pair is missed, and verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, partitions

SAMPLES = 256
GOLD = np.uint64(0x9E3779B97F4A7C15)
END = 0xFFFF
#: Characters of the rows that one walk holds at a time, and how often it drops texts that have ended.
HELD_CHARS, DROP_EVERY = 6_000_000, 32
#: Characters of a range of ids, on average.
RANGE_CHARS = 20_000_000
#: Fewer walkers than this go on one by one.
FEW = 100
#: Row k says which of 256 classes of characters move a pointer on at a step of kind k: each in 24 of the 32 kinds.
_DRAWN = mix64(np.arange(256 * 32, dtype=np.uint64) * GOLD + np.uint64(77)).reshape(256, 32)
_ROWS = np.append(_DRAWN.argsort(1).argsort(1) < 24, np.zeros((1, 32), bool), 0).T.astype(np.int64)
_LISTS = _ROWS.tolist()
_CLASS = (mix64(np.arange(1 << 16, dtype=np.uint64) * GOLD + np.uint64(78)) >> np.uint64(56)).astype(np.int64)
_CLASS[END] = 256


def text_codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) and c.max() >= END:
        c = np.minimum(np.where(c > 0xFFFF, (c ^ (c >> np.uint32(16))) & np.uint32(0xFFFF), c), END - 1)
    return c.astype(np.uint16)


def step_count(n: int) -> int:
    """Steps of a text of n characters: 4/3 n, and what chance may add."""
    return 4 * n // 3 + 3 * int(np.ceil(np.sqrt(n))) + 8 if n else 0


class Priorities:
    """Steps below a limit in order of their shared priority, for growing limits."""

    def __init__(self) -> None:
        self.size, self.order = 0, np.zeros(0, np.int64)

    def first(self, limit: int, count: int) -> np.ndarray:
        """The ``count`` steps of least priority below ``limit``."""
        if limit > self.size or limit * 4 < self.size:
            self.size = max(1024, 1 << int(np.ceil(np.log2(limit))))
            self.order = np.argsort(mix64(np.arange(self.size, dtype=np.uint64) * GOLD + np.uint64(5)), kind="stable")
        part = self.order[: int(count * self.size / limit * 1.5) + 64]
        part = part[part < limit]
        return part[:count] if len(part) >= min(count, limit) else self.order[self.order < limit][:count]


def symbols_at(flat: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes written with the pointer at ``at``: hashed from the next four characters, 0 at a text's end."""
    c = [np.where(at + k < ends, flat[np.minimum(at + k, len(flat) - 1)], END).astype(np.uint32) for k in range(4)]
    gram = c[0] * np.uint32(0x9E3779B1) + c[1] * np.uint32(0x85EBCA6B) + c[2] * np.uint32(0xC2B2AE35) + c[3] * np.uint32(0x27D4EB2F)
    return np.where(at < ends, (gram ^ (gram >> np.uint32(13))) * np.uint32(0x165667B1) >> np.uint32(24), 0).astype(np.uint8)


def step_kinds(count: int) -> np.ndarray:
    return (mix64(np.arange(count, dtype=np.uint64) * GOLD + np.uint64(9)) >> np.uint64(59)).astype(np.int64)


def walk(texts: list[np.ndarray], wanted: list[np.ndarray], twin: list[int] | None = None, shared: list[int] | None = None) -> list[np.ndarray]:
    """The symbols that each text's walk writes at its ``wanted`` steps.

    All texts walk in lock step, and only the pointers at wanted steps are kept.
    A text may name a ``twin`` (an earlier text, or -1) with which it shares its
    first characters, ``shared`` in number: it joins the walk where the twin's
    pointer comes near the end of those.  The last few walkers go on one by one.
    """
    count = len(texts)
    twin, shared = twin or [-1] * count, shared or [0] * count
    lengths = np.array([len(t) for t in texts], np.int64)
    steps = np.array([step_count(int(n)) for n in lengths], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    flat = np.full(int(lengths.sum()) + count, END, np.uint16)
    for a, t in zip(starts, texts):
        flat[a : a + len(t)] = t
    classes, kinds = _CLASS[flat], step_kinds(int(steps.max(initial=0)) + DROP_EVERY)
    # the wanted (step, text) in order of steps, and the pointers found there, relative to the text's start
    sizes = np.array([len(w) for w in wanted])
    asked, owner = np.concatenate([*wanted, np.zeros(0, np.int64)]), np.repeat(np.arange(count), sizes)
    order = np.argsort(asked, kind="stable")
    asked, owner = asked[order], owner[order]
    pointer = np.zeros(len(asked), np.int64)
    cuts = np.searchsorted(asked, np.arange(0, int(steps.max(initial=0)) + DROP_EVERY, DROP_EVERY))
    follows = np.where(steps > 0, np.array(twin, np.int64), -1)
    ids = np.flatnonzero((follows < 0) & (steps > 0))
    at, place = starts[ids], np.full(count, -1, np.int64)
    forks = np.full(count, -1, np.int64)
    forks[follows[follows >= 0]] = np.flatnonzero(follows >= 0)  # who waits for whom
    edge = np.array(shared, np.int64)
    waiting = int((follows >= 0).sum())

    def settle() -> None:
        """Where each text's pointer is to be read; a waiting text's is its twin's."""
        place[:] = -1
        place[ids] = np.arange(len(ids))
        held = np.flatnonzero((follows >= 0) & ~joined)
        place[held] = place[follows[held]]
        origin[ids] = starts[ids]
        origin[held] = starts[follows[held]]

    joined, origin = follows < 0, starts.copy()
    done, changed, span = 0, True, len(cuts) - 1
    while len(ids):
        if waiting:
            f = forks[ids]
            near = (f >= 0) & (at - starts[ids] + DROP_EVERY > edge[f])
            if near.any():
                new, by = f[near], at[near] - starts[ids[near]]
                forks[ids[near]], joined[new] = -1, True
                ids, at = np.concatenate([ids, new]), np.concatenate([at, starts[new] + by])
                waiting -= len(new)
                changed = True
        keep = steps[ids] > done
        if waiting:
            keep |= forks[ids] >= 0  # its twin is yet to join
        if not keep.all():
            ids, at, changed = ids[keep], at[keep], True
            if not len(ids):
                break
        if len(ids) < FEW:
            break
        if changed:
            settle()
            trace, drawn, changed = np.empty((DROP_EVERY + 1, len(ids)), np.int64), np.empty(len(ids), np.int64), False
            rows = list(trace)
        trace[0] = at
        if done + DROP_EVERY > len(kinds):
            kinds = step_kinds(2 * len(kinds))
        for here, there, kind in zip(rows, rows[1:], kinds[done : done + DROP_EVERY].tolist()):
            classes.take(here, out=drawn, mode="clip")
            _ROWS[kind].take(drawn, out=drawn, mode="clip")
            np.add(here, drawn, out=there)
        block = done // DROP_EVERY
        if block < span and cuts[block + 1] > cuts[block]:
            part = slice(cuts[block], cuts[block + 1])
            who = owner[part]
            pointer[part] = trace[asked[part] - done, place[who]] - origin[who]
        at = trace[DROP_EVERY].copy()
        done += DROP_EVERY
    if len(ids):  # too few for steps in common to pay
        own = np.argsort(owner[cuts[min(done // DROP_EVERY, span)] :], kind="stable") + cuts[min(done // DROP_EVERY, span)]
        listed = [_LISTS[k] for k in kinds.tolist()]

        def alone(i: int, j: int, a: int, marks: np.ndarray) -> list[int]:
            """Text i's pointers at the steps ``marks``, from pointer a at step j on."""
            own_classes, out = classes[starts[i] : starts[i] + lengths[i] + 1].tolist(), []
            for until in marks.tolist():
                for row in listed[j:until]:
                    a += row[own_classes[a]]
                j = until
                out.append(a)
            return out

        def marks_of(i: int) -> np.ndarray:
            return own[slice(*np.searchsorted(owner[own], [i, i + 1]))]

        for i, a in zip(ids.tolist(), (at - starts[ids]).tolist()):
            mine = marks_of(i)
            pointer[mine] = alone(i, done, a, asked[mine])
            if (f := int(forks[i])) >= 0:
                his = marks_of(f)
                m = int((pointer[mine] < edge[f]).sum()) if np.array_equal(asked[mine], asked[his]) else 0
                pointer[his[:m]] = pointer[mine[:m]]
                pointer[his[m:]] = alone(f, int(asked[mine[m - 1]]) if m else done, int(pointer[mine[m - 1]]) if m else a, asked[his[m:]])
    found = symbols_at(flat, starts[owner] + pointer, (starts + lengths)[owner])
    out = np.empty(len(found), np.uint8)
    out[order] = found
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return [out[a:b] for a, b in zip(offsets, offsets[1:])]


def marks(codes: list[np.ndarray], samples: int = SAMPLES, twin: list[int] | None = None, shared: list[int] | None = None) -> list[str]:
    """``<characters>:<hex of the sampled symbols in order of priority>``; for ``twin`` and ``shared`` see ``walk``."""
    priorities = Priorities()
    limits = [step_count(len(c)) for c in codes]
    chosen = {n: priorities.first(n, samples) if n else np.zeros(0, np.int64) for n in sorted(set(limits))}
    got = walk(codes, [chosen[n] for n in limits], twin, shared)
    return [f"{len(c)}:{g.tobytes().hex()}" for c, g in zip(codes, got)]


def fingerprints(texts: list[str], samples: int = SAMPLES) -> list[str]:
    return marks([text_codes(t) for t in texts], samples)


_shared = Priorities()


def likeness(a: str, b: str, samples: int = SAMPLES) -> float:
    """Share of the longer text's sampled steps at which both embeddings agree; two empty texts are alike."""
    if a == b:
        return 1.0
    (na, ha), (nb, hb) = a.split(":"), b.split(":")
    if int(na) < int(nb):
        na, ha, nb, hb = nb, hb, na, ha
    steps, short = step_count(int(na)), step_count(int(nb))
    if not short:
        return 0.0
    chosen = _shared.first(steps, samples)
    both = np.flatnonzero(chosen < short)
    x = np.frombuffer(bytes.fromhex(ha), np.uint8)[both]
    y = np.frombuffer(bytes.fromhex(hb), np.uint8)[: len(both)]
    return float((x == y).sum() / len(chosen))


def edited(text: str, following: str) -> str:
    """The last third replaced by as many (or all) of the next text's first characters."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(df: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list]:
    """Rows dealt into ranges of falling ids, each range also given the first rows of the next.

    Columns ``part, doc_id, text, tail``.  Null ids come last, ties go by text.
    The driver holds one id per range.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    bounds = sorted({*(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else [])}, reverse=True)
    marks = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # range p holds the ids that p of the bounds exceed; nulls come in the last
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.size(F.filter(marks, lambda b: b > F.col("doc_id"))))
    dealt = docs.withColumn("part", part.cast("int"))
    lead = F.coalesce("doc_id", F.lit(-(2**63)))
    heads = sorted((r["part"], r["h"]) for r in dealt.groupBy("part").agg(F.max(lead).alias("h")).collect())
    before = {p: heads[(i - 1) % len(heads)][0] for i, (p, _) in enumerate(heads)}
    if not heads:
        return dealt.withColumn("tail", F.lit(False)), heads
    first = F.create_map(*[F.lit(x) for p, h in heads for x in (p, h)])
    goes = F.create_map(*[F.lit(x) for p, q in before.items() for x in (p, q)])
    copies = dealt.withColumn("tail", F.explode(F.when(lead == first[F.col("part")], F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return copies.withColumn("part", F.when(F.col("tail"), goes[F.col("part")]).otherwise(F.col("part"))), heads


def fingerprint_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, its edited text's, and how alike the edited and the next text are to it.

    A null text counts as empty; the next row is that of the next smaller id,
    after the last the first; equal ids follow each other by text, null ids come
    last.  A single row is its own next.
    """
    spark = df.sparkSession
    chars = df.agg(F.coalesce(F.sum(F.length(F.col(text_col))), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-chars // RANGE_CHARS))  # a range doesn't grow with the corpus
    dealt, heads = with_next(df, parts, id_col, text_col)
    held = dealt.repartitionByRange(max(1, len(heads)), "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")

    def emit(rows: list[tuple], following: tuple) -> pd.DataFrame:
        texts = [t for _, t in rows]
        changed = [edited(t, n) for t, n in zip(texts, [*texts[1:], following[1]])]
        plain = [text_codes(t) for t in [*texts, following[1]]]
        keep = [len(t) - len(t) // 3 for t in texts]
        # an edited text is its own text up to the edit, and walks with it until then
        spliced = [np.concatenate([c[:k], n[: len(c) - k]]) for c, n, k in zip(plain, plain[1:], keep)]
        found = marks([*plain, *spliced], twin=[-1] * len(plain) + list(range(len(texts))), shared=[0] * len(plain) + keep)
        own, new = found[: len(texts) + 1], found[len(texts) + 1 :]
        return pd.DataFrame(
            {
                "doc_id": pd.array([d for d, _ in rows], "Int64"),
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in changed],
                "fingerprint": own[:-1],
                "edited_fingerprint": new,
                "near_edited": [likeness(a, b) for a, b in zip(own, new)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, part, chars, closed = [], None, 0, False
        for batch in batches:
            for p, doc, text, tail in zip(batch["part"], batch["doc_id"], batch["text"], batch["tail"]):
                doc = None if pd.isna(doc) else int(doc)
                if tail:
                    if p == part and not closed:  # the first of the next range; its ties are not needed
                        yield emit(rows, (doc, text))
                        rows, chars, closed = [], 0, True
                    continue
                if p != part:
                    part, closed = p, False
                if chars >= HELD_CHARS:
                    yield emit(rows, (doc, text))
                    rows, chars = [], 0
                rows.append((doc, text))
                chars += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return held.mapInPandas(run, schema)


# --- blocking and verification -------------------------------------------------

#: Texts and slots by which q-grams are put in order of frequency; they bear on speed alone.
ORDER_TEXTS, SLOTS = 2000, 1 << 20


def gram_size(least: float) -> int:
    """So short that texts within reach of each other share a q-gram, whatever their length."""
    return max(1, int(0.5 / max(1 - least, 1e-3)))


def grams(text: str, q: int) -> np.ndarray:
    """Hashes of the q-grams, each with its number among its equals."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - q + 1, np.uint64)
    for k in range(q):
        h = mix64(h * GOLD + c[k : len(c) - q + 1 + k])
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix64(h + nth.astype(np.uint64) * GOLD)


def block_keys(text: str, least: float, often: np.ndarray) -> np.ndarray:
    """The first k * q + 1 q-grams in the shared order, k the most edits to any text within reach.

    An edit changes at most q of the q-grams, so of two texts within k edits
    each has at most k * q that the other lacks: their first k * q + 1 meet.
    """
    q, k = gram_size(least), int((1 - least) * len(text) / least + 1e-6)
    if not k:
        return np.zeros(0, np.int64)
    g = grams(text, q)
    return g[np.lexsort((g, often[g % np.uint64(len(often))]))][: k * q + 1].view(np.int64)


def may_be_near(a: str, b: str, least: float) -> bool:
    """Whether the q-grams that both have are as many as k edits must leave."""
    q, n = gram_size(least), max(len(a), len(b))
    both = np.intersect1d(grams(a, q), grams(b, q), assume_unique=True)
    return len(both) >= n - q + 1 - q * int((1 - least) * n + 1e-6)


def edit_similarity(a: str, b: str, least: float) -> float:
    """1 - distance / longer length, exact where it is at least ``least``, else 0; banded."""
    if a == b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    k = int((1 - least) * n + 1e-9)
    if n - m > k:
        return 0.0
    x, y = np.array([*map(ord, a)], np.int64), np.array([*map(ord, b)], np.int64)
    width = 2 * k + 1
    shift = np.arange(width) - k  # column j of row i is i + shift
    row = np.where(shift >= 0, shift, n + m)
    for i in range(1, n + 1):
        j = i + shift
        inside = (j >= 0) & (j <= m)
        hit = np.where((j >= 1) & (j <= m), y[np.clip(j - 1, 0, max(0, m - 1))] != x[i - 1] if m else 1, 1)
        best = np.minimum(row + hit, np.append(row[1:], n + m) + 1)
        best = np.where(j == 0, i, best)
        best = np.where(inside, best, n + m)
        row = np.minimum.accumulate(best - shift) + shift
        row = np.where(inside, row, n + m)
        if row.min() > k:
            return 0.0
    d = int(row[m - n + k])
    return 1 - d / n if d <= k else 0.0


def near_pairs(df: DataFrame, least: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts whose edit similarity is at least ``least``.

    ``members``: (doc_id, class_id) - equal texts are one class, named by its
    smallest id.  ``links``: (a, b, similarity) between classes.  Null and empty
    texts are in no class.  Classes that share a block key meet, in blocks of
    bounded size; every pair within reach shares one.
    """
    from .components import BLOCK, members

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL")
    keyed = docs.withColumn("key", F.unhex(F.sha2("text", 256)))
    classes = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("text").alias("text"))

    often, q = np.zeros(SLOTS, np.int64), gram_size(least)
    for r in classes.select("text").limit(ORDER_TEXTS).toLocalIterator():
        often += np.bincount((grams(r["text"], q) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    shared = df.sparkSession.sparkContext.broadcast(often)  # a fixed size

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                found = block_keys(text, least, shared.value)
                yield pd.DataFrame({"key": [key] * len(found), "bucket": found, "n": len(text)})

    buckets = materialize(classes.select("key", "text").mapInPandas(keys_of, "key binary, bucket long, n long"))

    # one side whole, the other in blocks, so that no task has all pairs of a large bucket
    rows = members(buckets).withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    left = rows.select("bucket", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.col("key").alias("a"), F.col("n").alias("na"))
    right = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("key").alias("b"), F.col("n").alias("nb"))
    close = F.abs(F.col("na") - F.col("nb")) <= (1 - least) * F.greatest("na", "nb") + 1e-6
    found = left.join(right, ["bucket", "block"]).where(close & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    a, b = classes.selectExpr("key AS a", "class_id AS ca", "text AS ta"), classes.selectExpr("key AS b", "class_id AS cb", "text AS tb")

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_similarity(s, t, least) if may_be_near(s, t, least) else 0.0 for s, t in zip(x, y)], dtype="float64")

    links = found.join(a, "a").join(b, "b").withColumn("similarity", similarity("ta", "tb")).where(F.col("similarity") >= least)
    return keyed.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id"), links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "similarity")
