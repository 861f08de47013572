"""Lexicon matching, precision and recall, agreement of annotators, alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .common import broadcast_if_small, materialize


def match(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, sent_id, start, end, class): runs of tokens, by form or lemma, that spell an entry.

    Prefixes of entries take the part of trie states: a run goes on only while it
    spells one.  Only tokens that are a word of some entry are ever shuffled.
    """
    entries = lexicon.select(T.normalize_string(F.col("term")).alias("s"), F.col("polarity").alias("class")).distinct().withColumn("words", F.split("s", " "))
    entries = materialize(entries)
    longest = entries.agg(F.max(F.size("words"))).first()[0] or 0
    spelled = F.array_distinct(F.array(T.normalize_string(F.col("form")), T.normalize_string(F.col("lemma"))))
    words = broadcast_if_small(materialize(entries.select(F.explode("words").alias("w")).distinct()))
    alt = toks.select("doc_id", "sent_id", F.col("pos").alias("end"), F.explode(spelled).alias("w")).join(words, "w", "left_semi")
    if longest > 1:
        alt = materialize(alt)  # read once for each length
    runs, out = None, None
    for k in range(1, longest + 1):
        states = broadcast_if_small(materialize(entries.where(F.size("words") >= k).select(F.array_join(F.slice("words", 1, k), " ").alias("s")).distinct()))
        if runs is None:
            runs = alt.select("doc_id", "sent_id", F.col("end").alias("start"), "end", F.col("w").alias("s"))
        else:
            right = alt.withColumn("end", F.col("end") - 1)
            runs = runs.join(right, ["doc_id", "sent_id", "end"]).select("doc_id", "sent_id", "start", (F.col("end") + 1).alias("end"), F.concat_ws(" ", "s", "w").alias("s"))
        runs = runs.join(states, "s", "left_semi")
        full = runs.join(broadcast_if_small(entries.where(F.size("words") == k).select("s", "class")), "s").select("doc_id", "sent_id", "start", "end", "class")
        out = full if out is None else out.unionByName(full)
    if out is None:
        out = alt.select("doc_id", "sent_id", F.col("end").alias("start"), "end", F.col("w").alias("class")).limit(0)
    return out.distinct()


AT = ["doc_id", "sent_id", "end"]


def tally(toks: DataFrame, hits: DataFrame, gold: DataFrame, once: bool = False) -> DataFrame:
    """(doc_id, class, tp, fp, fn).

    At a token where a match ends, each match is right or wrong by ``gold(doc_id,
    sent_id, start, end, class)``, a wrong longer one also misses a neutral token,
    gold left over is missed, and so is a neutral token without gold.  Without a
    match the token is a right neutral, or a wrong one that misses its gold.
    ``once``: the tokens are known to be at a place of their own each.
    """
    return tally_sizes(toks, hits.withColumn("rank", F.lit(0)), gold, [0], once).drop("size")


def tally_sizes(toks: DataFrame, hits: DataFrame, gold: DataFrame, sizes: list[int], once: bool = False) -> DataFrame:
    """(size, doc_id, class, tp, fp, fn): ``tally`` of the hits up to each rank, in one pass over the tokens."""
    found = hits.groupBy(*AT, "start", "class").agg(F.min("rank").alias("h"))
    both = found.join(gold.select(*AT, "start", "class").distinct().withColumn("g", F.lit(1)), [*AT, "start", "class"], "full")
    g, no = F.col("g").isNotNull(), F.lit(False)
    hit = lambda size: F.coalesce(F.col("h") <= size, no)
    row = lambda size, kind, tp, fp, fn: F.struct(F.lit(size).alias("size"), kind.alias("class"), *[x.cast("long").alias(c) for x, c in ((tp, "tp"), (fp, "fp"), (fn, "fn"))])
    neutral = F.lit("neutral")
    each = []
    for size in sizes:
        each.append(row(size, F.col("class"), hit(size) & g, hit(size) & ~g, ~hit(size) & g))
        each.append(row(size, neutral, no, no, hit(size) & ~g & (F.col("start") != F.col("end"))))
    rows = both.select("doc_id", F.inline(F.array(*each))).where("tp + fp + fn > 0")
    names = [f"h{n}" for n in range(len(sizes))]
    if once:
        # a long holds 64 places of a sentence: of tokens, of gold's ends, and of the hits' of each size
        place = lambda c: [F.shiftright(c, 6).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int")).alias("bit")]
        bits = lambda flag: F.coalesce(F.bit_or(F.when(flag, F.col("bit"))), F.lit(0).cast("long"))
        have = toks.select("doc_id", "sent_id", *place(F.col("pos"))).groupBy("doc_id", "sent_id", "block").agg(F.bit_or("bit").alias("t"))
        ends = both.select("doc_id", "sent_id", "h", "g", *place(F.col("end"))).groupBy("doc_id", "sent_id", "block").agg(bits(g).alias("g"), *[bits(hit(size)).alias(n) for size, n in zip(sizes, names)])
        at = have.join(ends, ["doc_id", "sent_id", "block"], "left").fillna(0, ["g", *names])
        some = lambda x, y: F.bit_count(F.col("t").bitwiseAND(x).bitwiseAND(y))
        on, off = F.col, lambda c: F.bitwise_not(F.col(c))
    else:
        ends = both.groupBy(*AT).agg(F.max(g).alias("g"), *[F.max(hit(size)).alias(n) for size, n in zip(sizes, names)])
        at = toks.select("doc_id", "sent_id", F.col("pos").alias("end")).join(ends, AT, "left").fillna(False, ["g", *names])
        some = lambda x, y: x & y
        on, off = F.col, lambda c: ~F.col(c)
    token = at.select("doc_id", *[some(x, y).cast("long").alias(f"{c}{n}") for n in names for c, x, y in (("tp", off(n), off("g")), ("fp", off(n), on("g")), ("fn", on(n), off("g")))])
    token = token.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in token.columns[1:]])
    token = token.select("doc_id", F.inline(F.array(*[row(size, neutral, *[F.col(f"{c}{n}") for c in ("tp", "fp", "fn")]) for size, n in zip(sizes, names)])))
    out = rows.unionByName(token).groupBy("size", "doc_id", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return out.where("tp + fp + fn > 0")


def scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """Macro and micro precision, recall and F1 per ``by`` of ``counts(..., class, tp, fp, fn)``."""
    p = F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    out = counts.groupBy(*by).agg(F.avg(p).alias("macro_p"), F.avg(r).alias("macro_r"), F.avg(f).alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    mp, mr = F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return out.withColumns({"micro_p": mp, "micro_r": mr}).withColumn("micro_f1", F.when(F.col("tp") > 0, 2 * F.col("micro_p") * F.col("micro_r") / (F.col("micro_p") + F.col("micro_r"))).otherwise(0.0)).drop("tp", "fp", "fn")


def spread(per_file: DataFrame) -> DataFrame:
    """Mean and population deviation over files."""
    names = [c for c in per_file.columns if c.startswith(("macro", "micro"))]
    return per_file.agg(*[x for c in names for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def pooled(counts: DataFrame) -> DataFrame:
    return scores(counts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("all", F.lit(1)), ["all"]).drop("all")


def corpus_diff(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Lexicon hits that the gold lacks (``missing``) and gold that no entry hits (``redundant``)."""
    key = ["doc_id", "sent_id", "start", "end", "class"]
    return hits.join(gold, key, "left_anti").select(*key, F.lit("missing").alias("kind")).unionByName(gold.distinct().join(hits, key, "left_anti").select(*key, F.lit("redundant").alias("kind")))


def overlap(a: DataFrame, b: DataFrame, scheme: str) -> DataFrame:
    """(class, t1, o1, t2, o2): tokens of each annotator's spans, and those that agree.

    ``a`` and ``b`` are (doc_id, class, ids).  ``binary``: a span that shares a
    token counts whole; ``proportional``: the shared tokens; ``exact``: spans alike.
    """

    def side(x: DataFrame, y: DataFrame, n: int) -> DataFrame:
        spans = x.select("doc_id", "class", "ids").distinct()
        if scheme == "exact":
            return spans.join(y.select("doc_id", "class", "ids").distinct().withColumn("hit", F.lit(1)), ["doc_id", "class", "ids"], "left").groupBy("class").agg(F.sum(F.size("ids")).alias(f"t{n}"), F.sum(F.when(F.col("hit") == 1, F.size("ids")).otherwise(0)).alias(f"o{n}"))
        other = y.select("doc_id", "class", F.explode("ids").alias("id")).distinct().withColumn("hit", F.lit(1))
        token = spans.withColumn("id", F.explode("ids")).join(other, ["doc_id", "class", "id"], "left")
        one = token.groupBy("doc_id", "class", "ids").agg(F.count("hit").alias("c"), F.count("*").alias("n"))
        shared = F.when(F.col("c") > 0, F.col("n")).otherwise(0) if scheme == "binary" else F.col("c")
        return one.groupBy("class").agg(F.sum("n").alias(f"t{n}"), F.sum(shared).alias(f"o{n}"))

    out = side(a, b, 1).join(side(b, a, 2), "class", "full")
    return out.select("class", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("t1", "o1", "t2", "o2")])


def without_emoticons(spans: DataFrame, words: DataFrame) -> DataFrame:
    """``spans(doc_id, class, ids)`` less those all of whose ``words(doc_id, id, word)`` are emoticons."""
    one = spans.select("doc_id", "class", "ids", F.explode("ids").alias("id")).join(words, ["doc_id", "id"], "left")
    kept = one.groupBy("doc_id", "class", "ids").agg(F.collect_list("word").alias("w")).where(~(T.is_emoticon(F.col("w")) & (F.size("w") == F.size("ids"))))
    return kept.select("doc_id", "class", "ids")


def overlap_by_file(a: DataFrame, b: DataFrame, sizes: DataFrame, scheme: str) -> DataFrame:
    """(doc_id, class, t1, o1, t2, o2, kappa) per document; ``sizes(doc_id, n)`` are the documents' tokens."""
    named = lambda x: x.select("doc_id", F.to_json(F.struct("doc_id", "class")).alias("class"), "ids")
    keyed = overlap(named(a), named(b), scheme)
    own = keyed.withColumn("doc_id", F.get_json_object("class", "$.doc_id").cast(dict(a.dtypes)["doc_id"])).withColumn("class", F.get_json_object("class", "$.class")).join(sizes, "doc_id")
    n = F.col("n").cast("double")
    c1, c2 = F.col("t1") / n, F.col("t2") / n
    seen = (n - F.col("t1") + F.col("o1") - F.col("t2") + F.col("o2")) / n
    chance = c1 * c2 + (1 - c1) * (1 - c2)
    return own.withColumn("kappa", F.when((n > 0) & (chance < 1), (seen - chance) / (1 - chance)).otherwise(0.0)).drop("n")


def kappa(counts: DataFrame, n: int) -> DataFrame:
    """Cohen's kappa of ``overlap`` counts among ``n`` tokens; 0 if chance agrees always or there are no tokens."""
    if not n:
        return counts.withColumn("kappa", F.lit(0.0))
    c1, c2 = F.col("t1") / n, F.col("t2") / n
    seen = (n - F.col("t1") + F.col("o1") - F.col("t2") + F.col("o2")) / F.lit(float(n))
    chance = c1 * c2 + (1 - c1) * (1 - c2)
    return counts.withColumn("kappa", F.when(chance < 1, (seen - chance) / (1 - chance)).otherwise(0.0))


def align(a: list[str], b: list[str], gap: int = -2, hit: int = 2, miss: int = -1, held: int = 1 << 24) -> list[list[int]]:
    """Global alignment: for each item of ``a`` the indexes of ``b``; of equal scores substitution comes first, then insertion.

    Rows are halved until a block has at most ``held`` cells, whose moves are kept; other rows are computed again.
    """
    codes: dict = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in s], np.int64) for s in (a, b))
    out: list[list[int]] = [[] for _ in a]
    slope = gap * np.arange(len(b) + 1, dtype=np.int64)

    def following(row: np.ndarray, i: int, moves: np.ndarray | None = None) -> np.ndarray:
        """The scores of row ``i`` from those of the row before."""
        m = len(row) - 1
        swap = row[:-1] + np.where(y[:m] == x[i - 1], hit, miss)
        best = row + gap
        np.maximum(best[1:], swap, out=best[1:])
        new = np.maximum.accumulate(best - slope[: m + 1]) + slope[: m + 1]
        if moves is not None:
            moves[1:] = np.where(new[1:] == swap, 0, np.where(new[1:] == new[:-1] + gap, 1, 2))
        return new

    def back(top: int, end: int, row: np.ndarray, j: int) -> int:
        """From row ``end``, column ``j`` up to row ``top``, whose scores are ``row``: the column reached."""
        row = row[: j + 1]
        if end - top > 1 and (end - top) * (j + 1) > held:
            mid = (top + end) // 2
            at = row
            for i in range(top + 1, mid + 1):
                at = following(at, i)
            return back(top, mid, row, back(mid, end, at, j))
        moves = np.zeros((end - top, j + 1), np.uint8)
        for i in range(top + 1, end + 1):
            row = following(row, i, moves[i - top - 1])
        i = end
        while i > top and j:
            move = moves[i - top - 1, j]
            if move != 2:
                j -= 1
                out[i - 1].append(j)
            if move != 1:
                i -= 1
        return j

    back(0, len(a), slope, len(b))
    return [js[::-1] for js in out]


def align_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with ``aligned``: two array columns aligned row by row."""

    @F.pandas_udf("array<array<int>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([align(list(s), list(t)) if s is not None and t is not None else None for s, t in zip(x, y)])

    return df.withColumn("aligned", run(a, b))


def cardinality_search(toks: DataFrame, lexicon: DataFrame, gold: DataFrame, sizes: list[int], once: bool = False) -> DataFrame:
    """(size, macro_p, ..., micro_f1): the scores of the ``size`` strongest entries for each size, pooled over all documents.

    Entries are matched once, each with its rank; a prefix of the lexicon is then
    a filter on hits, and all prefixes are counted in one pass.
    """
    from pyspark.sql import Window

    n = max(sizes)
    best = lexicon.orderBy(F.abs("score").desc(), "term").limit(n)
    ranked = materialize(best.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("score").desc(), "term"))))
    spelled = ranked.select(T.normalize_string(F.col("term")).alias("s"), F.col("polarity").alias("class"), "rank").groupBy("s", "class").agg(F.min("rank").alias("rank"))
    hits = materialize(match_ranked(toks, spelled))
    counts = tally_sizes(toks, hits, gold, sizes, once).groupBy("size", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    out = scores(counts, ["size"])
    return out.select(*[c for c in out.columns if c != "size"], "size")


def match_ranked(toks: DataFrame, spelled: DataFrame) -> DataFrame:
    """``match`` with the rank of the entry: the least where several spell the same."""
    # an entry of its own for each spelling and class, named by its rank
    named = spelled.select(F.col("s").alias("term"), F.concat_ws("|", "class", F.col("rank").cast("string")).alias("polarity"))
    parts = F.split("class", r"\|")
    return match(toks, named).select("doc_id", "sent_id", "start", "end", parts[1].cast("int").alias("rank"), parts[0].alias("class"))


def running_best(results: DataFrame, order: str = "size", value: str = "macro_f1") -> DataFrame:
    """The row of the greatest ``value``, of equal ones the last in order."""
    return results.agg(F.max_by(F.struct(*results.columns), F.struct(value, order)).alias("b")).select("b.*")


def method_matrix(toks: DataFrame, gold: DataFrame, methods: dict, seed_sets: dict, sizes: list[int]) -> DataFrame:
    """(method, seeds, size, ...): the best prefix of each method's lexicon from each seed set.

    ``methods``: name to a function from seeds to a lexicon; ``seed_sets``: name to seeds.
    """
    out = None
    for name, method in methods.items():
        for label, seeds in seed_sets.items():
            best = running_best(cardinality_search(toks, method(seeds), gold, sizes)).withColumn("method", F.lit(name)).withColumn("seeds", F.lit(label))
            out = best if out is None else out.unionByName(best)
    return out
