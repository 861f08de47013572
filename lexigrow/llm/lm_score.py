"""Language-model scores by stupid backoff, computed relationally.

A bigram model of the corpus scores every document of the same corpus with that
document's own counts left out: ``S(w | u) = c(u w) / c(u)`` if another document
has ``u w``, else ``0.4 c(w) / N``; a word that no other document has counts as
half a word.  A document's first word is scored as ``c(w) / N``.

The count tables are partitioned by hash:

1. Documents are cut into chunks of about ``CHUNK_WORDS`` words, and each word
   becomes a code of the chunk's dictionary.
2. A chunk's distinct n-grams and their counts go to the partitions of their
   hashes: sorted hashes, packed as differences.  So a frequent n-gram comes at
   most once per chunk, however many rows hold it.
3. A partition adds up the counts and answers each chunk, in the order in which
   it asked, so that an answer is numbers only.
4. A chunk's answers meet its documents, whose own counts are taken off.

Ids that come in several rows are one document: their n-grams go on as rows of
(id, n-gram) with the answers, and are summed by Spark before they are scored.

What moves is in proportion to the corpus, and no group grows with it: a chunk
and a partition of about ``PART_CHARS`` characters are of bounded size.  Chunks
times partitions bound the number of packed blobs; where that is large, raise
``chunk_words`` with the workers' memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, partitions

ALPHA, UNSEEN = 0.4, 0.5
#: Words of a chunk, and characters of text for each partition of the count tables.
CHUNK_WORDS, PART_CHARS = 1_000_000, 16_000_000
MEMO = 250_000
NULL_ID = -(2**63)
GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Hashes()


def words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(u * GOLD + w)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Partitions as ranges of the hash, so that keys sorted by hash are sorted by partition."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns, each with its length: byte planes of the values, or of their differences if they rise, compressed together."""
    parts = [bytes([len(columns)])]
    for c in columns:
        x = c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)
        rises = len(c) > 1 and bool((c[1:] >= c[:-1]).all())
        d = np.diff(x, prepend=np.int64(0)) if rises else x
        planes = d.view(np.uint8).reshape(-1, 8)
        used = 8 if len(d) and d.min() < 0 else next((k for k in range(8, 0, -1) if planes[:, k - 1].any()), 0)
        parts += [np.array([len(c), rises, used], np.int64).tobytes(), np.ascontiguousarray(planes[:, :used].T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        n, rises, used = np.frombuffer(raw, np.int64, 3, at).tolist()
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :used] = np.frombuffer(raw, np.uint8, n * used, at + 24).reshape(used, n).T
        x = planes.view(np.int64).ravel()
        out.append(np.cumsum(x, dtype=np.int64) if rises else x)
        at += 24 + used * n
    return out


def codes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, sorted, each row's place among them, and how often each comes."""
    order = np.argsort(values, kind="stable")
    rows = values[order]
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    at = np.flatnonzero(new)
    code = np.empty(len(rows), np.int64)
    code[order] = np.cumsum(new) - 1
    return rows[at], code, np.diff(np.append(at, len(rows)))


def tokenised(chunk_words: int):
    """Chunks ``(n_words, several, blob)``: document ids, words of each, whether its id comes again, word hashes, codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, hashes, again, n = [], [], [], 0

        def close() -> pd.DataFrame:
            names, code, _ = codes_of(np.concatenate(hashes))
            blob = pack(np.array(docs, np.int64), np.array([len(h) for h in hashes]), np.array(again, np.int64), names, code)
            return pd.DataFrame({"n_words": [n], "several": [any(again)], "blob": [blob]})

        for batch in batches:
            for doc, text, several in zip(batch["doc_id"], batch["text"], batch["several"]):
                if s := words(text if isinstance(text, str) else None):
                    if len(_words) > MEMO:
                        _words.clear()
                    docs.append(NULL_ID if pd.isna(doc) else int(doc))
                    again.append(bool(several))
                    hashes.append(np.array([_words[w] for w in s], np.uint64))
                    n += len(s)
                if n >= chunk_words:
                    yield close()
                    docs, hashes, again, n = [], [], [], 0
        if n:
            yield close()

    return run


class Chunk:
    """A chunk's words and bigrams as codes of sorted hashes."""

    def __init__(self, blob: bytes) -> None:
        self.ids, self.lengths, self.again, names, self.w = unpack(blob)
        self.names = names.view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.first = np.zeros(len(self.w), bool)
        self.first[starts] = True
        self.at = np.flatnonzero(~self.first)
        self.pairs, self.pair, self.pair_counts = codes_of(pair_key(self.names[self.w[self.at - 1]], self.names[self.w[self.at]]))
        self.word_counts = np.bincount(self.w, minlength=len(self.names))
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)


def requests(parts: int):
    """A chunk's distinct bigrams and words with their counts, packed by partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"], batch["blob"]):
                c = Chunk(blob)
                bounds = np.arange(parts + 1)
                p = np.searchsorted(part_of(c.pairs, parts), bounds)
                q = np.searchsorted(part_of(c.names, parts), bounds)
                rows = [(chunk, k, pack(c.pairs[p[k] : p[k + 1]], c.pair_counts[p[k] : p[k + 1]], c.names[q[k] : q[k + 1]], c.word_counts[q[k] : q[k + 1]])) for k in range(parts) if p[k] < p[k + 1] or q[k] < q[k + 1]]
                yield pd.DataFrame(rows, columns=["chunk", "part", "blob"])

    return run


def answers(group: pd.DataFrame) -> pd.DataFrame:
    """One partition of the count tables: to each chunk the sums over all chunks, in its own order."""
    opened = [unpack(b) for b in group["blob"]]
    totals = []
    for k in (0, 2):
        _, code, _ = codes_of(np.concatenate([o[k] for o in opened]).view(np.uint64))
        sums = np.bincount(code, np.concatenate([o[k + 1] for o in opened])).astype(np.int64)  # exact up to 2 ** 53
        totals.append(np.split(sums[code] if len(code) else code, np.cumsum([len(o[k]) for o in opened])[:-1]))
    return pd.DataFrame({"chunk": group["chunk"], "part": group["part"], "blob": [pack(a, b) for a, b in zip(*totals)]})


def answered(group: pd.DataFrame) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """A chunk with the corpus' counts of its bigrams and words."""
    group = group.sort_values("part")
    c = Chunk(group["blob"].iat[0])
    replies = [unpack(b) for b in group["blob"].iloc[1:]]
    return c, np.concatenate([np.zeros(0, np.int64), *[r[0] for r in replies]]), np.concatenate([r[1] for r in replies])


def score_chunk(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of each document whose id comes in one row."""
    c, pair_total, word_total = answered(group)
    own = codes_of(c.doc * np.int64(len(c.names)) + c.w)
    own_w = own[2][own[1]]
    own = codes_of(c.doc[c.at] * np.int64(max(1, len(c.pairs))) + c.pair)
    others = np.zeros(len(c.w), np.int64)
    others[c.at] = pair_total[c.pair] - own[2][own[1]]
    rest = word_total[c.w] - own_w
    before = np.concatenate([[0], rest[:-1]])
    known = others > 0
    log = np.log(np.where(known, others, np.where(rest > 0, rest, UNSEEN)))
    log -= np.where(known, np.log(np.maximum(before, 1)), np.where(c.first, 0.0, -math.log(ALPHA)))
    add = lambda x: np.bincount(c.doc, x, len(c.ids))
    hits, unseen = add(known).astype(np.int64), add(~known & (rest <= 0)).astype(np.int64)
    keep = c.again == 0
    return pd.DataFrame({"doc_id": c.ids, "log": add(log), "hits": hits, "words": c.lengths, "unseen": unseen})[keep]


def bigram_rows(group: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, u, w, c, and the corpus' counts of ``u w``, u and w) of documents whose ids come in several rows."""
    c, pair_total, word_total = answered(group)
    pair = np.full(len(c.w), -1, np.int64)
    pair[c.at] = c.pair
    u = np.where(c.first, -1, np.concatenate([[0], c.w[:-1]]))
    held = c.again[c.doc] > 0
    df = pd.DataFrame({"doc_id": c.ids[c.doc], "u": u, "w": c.w, "pair": pair})[held].groupby(["doc_id", "u", "w", "pair"], as_index=False).size()
    u, w, pair = df["u"].to_numpy(), df["w"].to_numpy(), df["pair"].to_numpy()
    name = c.names.view(np.int64)
    inner = u >= 0
    return pd.DataFrame(
        {
            "doc_id": df["doc_id"], "u": pd.arrays.IntegerArray(np.where(inner, name[u], 0), ~inner), "w": name[w], "c": df["size"],
            "n_pair": np.where(inner, np.append(pair_total, 0)[pair], 0), "n_u": np.where(inner, word_total[u], 0), "n_w": word_total[w],
        }
    )


def score_several(rows: DataFrame) -> DataFrame:
    """Sums of documents of several rows, from their bigram rows; skewed ids and words are pre-aggregated."""
    b = rows.groupBy("doc_id", "u", "w").agg(F.sum("c").alias("c"), F.first("n_pair").alias("n_pair"), F.first("n_u").alias("n_u"), F.first("n_w").alias("n_w"))
    b = materialize(b)
    own = b.groupBy("doc_id", "w").agg(F.sum("c").alias("own"))
    d = b.join(own.withColumnRenamed("own", "own_w"), ["doc_id", "w"]).join(own.select("doc_id", F.col("w").alias("u"), F.col("own").alias("own_u")), ["doc_id", "u"], "left")
    others, rest = F.col("n_pair") - F.col("c"), F.col("n_w") - F.col("own_w")
    known = F.col("u").isNotNull() & (others > 0)
    backed = F.log(F.when(rest > 0, rest).otherwise(F.lit(UNSEEN))) + F.when(F.col("u").isNull(), F.lit(0.0)).otherwise(F.lit(math.log(ALPHA)))
    log = F.when(known, F.log(others) - F.log(F.greatest(F.col("n_u") - F.col("own_u"), F.lit(1)))).otherwise(backed)
    c = F.col("c")
    return d.groupBy("doc_id").agg(
        F.sum(c * log).alias("log"), F.sum(F.when(known, c).otherwise(0)).alias("hits"), F.sum(c).alias("words"), F.sum(F.when(~known & (rest <= 0), c).otherwise(0)).alias("unseen")
    )


#: Repeated ids up to this many are broadcast to the texts; more are joined by shuffle.
BROADCAST_IDS = 200_000


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_known_bigrams, n_unseen, logprob, score): a row per id whose text has words.

    ``logprob`` is the sum of natural logarithms, ``score`` its mean per word,
    both rounded to four digits.  Rows with one id are separate histories of one
    document.  Null ids count as one id.  Null and blank texts have no row, nor
    has an empty table.  If there is no other document, N counts as half a word.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-chars // PART_CHARS))
    ids = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")))
    repeated = ids.count()
    if repeated:
        side = ids.withColumn("several", F.lit(True))
        docs = docs.join(F.broadcast(side) if repeated <= BROADCAST_IDS else side, docs.doc_id.eqNullSafe(F.col("_again")), "left")
        docs = docs.select("doc_id", "text", F.coalesce("several", F.lit(False)).alias("several"))
    else:
        docs = docs.withColumn("several", F.lit(False))
    chunks = materialize(docs.mapInPandas(tokenised(chunk_words), "n_words long, several boolean, blob binary").withColumn("chunk", F.monotonically_increasing_id()))
    total = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    packed = "chunk long, part int, blob binary"
    counts = chunks.select("chunk", "blob").mapInPandas(requests(parts), packed).groupBy("part").applyInPandas(answers, packed)
    schema = "doc_id long, log double, hits long, words long, unseen long"
    both = chunks.select("chunk", F.lit(-1).alias("part"), "blob").union(counts)
    if repeated:
        both = materialize(both)
    by_doc = both.groupBy("chunk").applyInPandas(score_chunk, schema)
    if repeated:
        held = both.join(chunks.where("several").select("chunk"), "chunk", "left_semi")
        found = held.groupBy("chunk").applyInPandas(bigram_rows, "doc_id long, u long, w long, c long, n_pair long, n_u long, n_w long")
        by_doc = by_doc.unionByName(score_several(found))
    rest = F.col("words") - F.col("hits")
    logprob = F.col("log") - rest * F.log(F.greatest(F.lit(total) - F.col("words"), F.lit(UNSEEN)))
    return by_doc.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), F.col("words").alias("n_words"), F.col("hits").alias("n_known_bigrams"), F.col("unseen").alias("n_unseen"), F.round(logprob, 4).alias("logprob"), F.round(logprob / F.col("words"), 4).alias("score")
    )


LM_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(list_prepend(NULL, ws)[1:len(ws)]) AS u FROM d WHERE len(ws) > 0),
b AS (SELECT u, w, doc_id, count(*) AS c FROM t GROUP BY u, w, doc_id),
b2 AS (SELECT *, CASE WHEN u IS NULL THEN 0 ELSE sum(c) OVER (PARTITION BY u, w) - c END AS others FROM b),
o AS (SELECT w, doc_id, count(*) AS c FROM t GROUP BY w, doc_id),
o2 AS (SELECT *, sum(c) OVER (PARTITION BY w) - c AS others FROM o),
n AS (SELECT doc_id, count(*) AS words, (SELECT count(*) FROM t) AS total FROM t GROUP BY doc_id),
s AS (SELECT b2.doc_id, b2.c, b2.others > 0 AS known, ow.others = 0 AS unseen,
  CASE WHEN b2.others > 0 THEN ln(b2.others) - ln(ou.others)
    ELSE CASE WHEN b2.u IS NULL THEN 0 ELSE ln(0.4) END + ln(CASE WHEN ow.others > 0 THEN ow.others ELSE 0.5 END) - ln(CASE WHEN total > words THEN total - words ELSE 0.5 END) END AS l
  FROM b2 JOIN n ON n.doc_id = b2.doc_id JOIN o2 ow ON ow.w = b2.w AND ow.doc_id = b2.doc_id LEFT JOIN o2 ou ON ou.w = b2.u AND ou.doc_id = b2.doc_id)
SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_words, CAST(coalesce(sum(c) FILTER (WHERE known), 0) AS BIGINT) AS n_known_bigrams,
  CAST(coalesce(sum(c) FILTER (WHERE unseen AND NOT known), 0) AS BIGINT) AS n_unseen, round(sum(c * l), 4) AS logprob, round(sum(c * l) / sum(c), 4) AS score
FROM s GROUP BY doc_id
"""
