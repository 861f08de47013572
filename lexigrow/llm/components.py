"""Linking nodes that share buckets: candidate edges, verification, components.

Nodes are opaque binary keys.  Candidates come in three rounds, each against
what the last has settled: every bucket member with the bucket's smallest key;
every member of a bucket that still spans several components with the member of
most verified links; at last the pairs across components in what is left, in
blocks of bounded size.  A block looks at each of its pairs and emits a spanning
forest of those that link.  So a group of many near copies collapses along stars
and never becomes all its pairs, and yet every pair of one bucket that could
still join two components is looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, gather, release

#: Members in a block of a bucket whose pairs one task compares.
BLOCK = 512
DOUBT, SURE = 1, 2


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key reachable over undirected ``edges(a, b)``.

    Each round takes the least label among neighbours and then that label's own
    label, so long chains shorten geometrically.  Keys without edges are absent.
    """
    both = gather(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = gather(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")))
    while True:
        seen = both.join(labels, both.b == labels.key).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen, labels.key == seen.a).select("key", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("key").alias("label"), F.col("label").alias("above"))
        after = gather(near.join(up, "label").select("key", "was", F.least("label", "above").alias("label")))
        labels = forget(after.select("key", "label"))
        if after.where("was <> label").isEmpty():
            break
    del both, seen, near, up, after
    release(edges.sparkSession)
    return labels


def members(buckets: DataFrame) -> DataFrame:
    """``(key, bucket)`` rows of buckets that hold more than one key, with the bucket's size and least key.

    Of buckets with the same members only that of the least band (the lowest five
    bits) is kept: the others would offer the same pairs again.
    """
    same = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    several = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("hub"), *same).where("size > 1")
    band = F.struct(F.col("bucket").bitwiseAND(F.lit(31)), F.col("bucket").alias("bucket"))
    kept = gather(several.groupBy("size", "hub", "x0", "x1").agg(F.min(band).alias("b")).select(F.col("b.bucket").alias("bucket"), "size", "hub"))
    # joined apart from any aggregation by bucket, so that a large bucket's rows can be split among tasks
    return buckets.join(kept, "bucket")


def pairs(a, b) -> tuple:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def block_pairs(rest: DataFrame, choose: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Pairs across labels within each bucket of ``rest(bucket, key, label, ...)`` that ``choose`` picks.

    Members of a bucket's commonest label need no comparison with each other, so
    they and the others are cut into blocks of at most about BLOCK members
    apart; each pair of blocks, but for pairs of two common ones, is one group of
    bounded size.  ``choose`` gets a group and two index arrays of its pairs and
    returns for each 0, DOUBT or SURE; a pair that is 0 isn't emitted.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        label = pd.factorize(group["label"])[0]
        lo, hi, block = group["lo"].iat[0], group["hi"].iat[0], group["block"].to_numpy()
        i, j = np.triu_indices(len(group), 1)
        ok = label[i] != label[j]
        if lo != hi:
            ok &= block[i] != block[j]
        i, j = i[ok], j[ok]
        if len(i):
            picked = choose(group, i, j)
            i, j, picked = i[picked > 0], j[picked > 0], picked[picked > 0]
        else:
            picked = np.zeros(0, np.int8)
        keys = group["key"].to_numpy()
        return pd.DataFrame({"a": keys[i], "b": keys[j], "sure": picked == SURE})

    counts = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    common = counts.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = common.select("bucket", "top", blocks(F.col("all") - F.col("top.c")).alias("few"), blocks(F.col("top.c")).alias("many"))
    sizes = gather(sizes.where("few > 0"))
    is_top = F.col("label") == F.col("top.label")
    dealt = (
        rest.join(sizes, "bucket")
        .withColumn("block", F.when(is_top, F.col("few") + F.pmod(F.xxhash64("key"), F.col("many"))).otherwise(F.pmod(F.xxhash64("key"), F.col("few"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_top, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
        .select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *[c for c in rest.columns if c != "bucket"])
    )
    return dealt.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a binary, b binary, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def spanning(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs, taken in order, join parts that were apart until then."""
    parent = list(range(int(label.max(initial=-1)) + 1))
    out = np.zeros(len(i), bool)
    left = len(set(label.tolist())) - 1
    for k, (a, b) in enumerate(zip(label[i].tolist(), label[j].tolist())):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out[k] = True
            left -= 1
            if not left:
                break
    return out


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], enrich: Callable[[DataFrame, int], DataFrame], choose: Callable) -> DataFrame:
    """(key, label) of linked keys.

    ``buckets(key, bucket)``; ``verify`` returns those of the candidate edges
    that hold; ``enrich(rest, round)`` adds what ``choose`` needs to tell which
    pairs of a block would join parts.  As long as one of the pairs that it was
    sure of does not hold, the round is repeated, with other bits of the hashes.
    """
    shared = gather(members(buckets))
    tried = gather(shared.where("key <> hub").select(*pairs(F.col("key"), F.col("hub"))).distinct())
    edges = gather(verify(tried))
    labels = components(edges)

    def open_buckets(rows: DataFrame, labels: DataFrame) -> DataFrame:
        marked = rows.join(labels, "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
        still = marked.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("bucket")
        return marked.join(gather(still), "bucket")

    rest = gather(open_buckets(shared.select("bucket", "key"), labels))
    if rest.isEmpty():
        return labels
    del shared
    release(buckets.sparkSession)
    ends = edges.select(F.col("a").alias("key")).union(edges.select("b")).groupBy("key").agg(F.count("*").alias("degree"))
    ranked = rest.join(ends, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = gather(ranked.groupBy("bucket").agg(F.min_by(F.struct("key", "label"), F.struct(-F.col("degree"), F.col("key"))).alias("top")))
    star = rest.join(best, "bucket").where("label <> top.label").select(*pairs(F.col("key"), F.col("top.key"))).distinct().join(tried, ["a", "b"], "left_anti")
    edges = edges.union(gather(verify(gather(star))))
    labels = components(edges)
    del best, ends, ranked, star, tried
    for turn in count():
        release(buckets.sparkSession)
        rest = gather(open_buckets(rest.select("bucket", "key"), labels))
        if rest.isEmpty():
            return labels
        chosen = gather(block_pairs(enrich(rest, turn), choose))
        if chosen.isEmpty():
            return labels
        held = gather(verify(chosen.select("a", "b")))
        edges = edges.union(held)
        labels = components(edges)
        if chosen.where("sure").join(held, ["a", "b"], "left_anti").isEmpty():
            return labels
