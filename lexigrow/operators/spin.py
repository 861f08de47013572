"""The spin model: a network of terms from glosses, relations, synsets and conjunctions, and its mean field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import materialize, top
from .corpus import NEGATORS, seed_match
from .net import ANTONYM, SYNONYM, Net

CAP, BETA, ALPHA, EPSILON, SWEEPS = 4.0, 0.8, 10.0, 1e-3, 5000


def gloss_edges(net: Net, texts: DataFrame, form2lemma: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(a, b, w): a synset's terms with the known lemmas of its glosses; -1 after a negator of the same synset, else 1."""
    words = texts.select("synid", "kind", F.posexplode(T.tokenize(F.coalesce("txt", F.lit("")))).alias("i", "word")).withColumn("lemma", T.normalize(F.col("word")))
    if form2lemma is not None:
        words = words.join(form2lemma.select(F.col("form").alias("lemma"), F.col("lemma").alias("_l")), "lemma", "left").withColumn("lemma", F.coalesce("_l", "lemma")).drop("_l")
    known = words.join(net.lex_form.select(F.col("form").alias("lemma")).distinct(), "lemma", "left_semi") if form2lemma is None else words.join(net.lex_form.select(F.col("form").alias("lemma")).union(form2lemma.select("lemma")).distinct(), "lemma", "left_semi")
    negator = F.col("lemma").isin(*NEGATORS)
    # negators count whether or not the net has them
    every = known.unionByName(words.where(negator)).distinct()
    w = Window.partitionBy("synid").orderBy("kind", "i").rowsBetween(Window.unboundedPreceding, -1)
    scoped = every.withColumn("w", F.when(F.max(negator.cast("int")).over(w) == 1, -1.0).otherwise(1.0)).where(~negator)
    if stop is not None:
        scoped = scoped.join(stop.select(F.col("form").alias("lemma")), "lemma", "left_anti")
    m = net.members().select("synid", "form").distinct()
    return m.join(scoped.select("synid", "lemma", "w"), "synid").select(F.col("form").alias("a"), F.col("lemma").alias("b"), "w")


def relation_edges(net: Net) -> DataFrame:
    """(a, b, w): 1 for synonym-like relations and synset mates, -1 for antonyms."""
    sign = F.when(F.col("rel").isin(*SYNONYM), 1.0).when(F.col("rel").isin(*ANTONYM), -1.0)
    m = net.members().select("synid", "lexid", "form")
    lex = net.lex_rel.withColumn("w", sign).where("w IS NOT NULL").join(net.lex_form.selectExpr("lexid AS from_lex", "form AS a"), "from_lex").join(net.lex_form.selectExpr("lexid AS to_lex", "form AS b"), "to_lex").select("a", "b", "w")
    syn = m.select("synid", "form").distinct()
    con = net.con_rel.withColumn("w", sign).where("w IS NOT NULL").join(m.selectExpr("synid AS from_syn", "form AS a"), "from_syn").join(m.selectExpr("synid AS to_syn", "form AS b"), "to_syn").select("a", "b", "w")
    mates = syn.join(syn.withColumnRenamed("form", "b"), "synid").where("form < b").select(F.col("form").alias("a"), "b", F.lit(1.0).alias("w"))
    return lex.unionByName(con).unionByName(mates)


def network(*edges: DataFrame) -> DataFrame:
    """(a, b, w) both ways: weights of a pair sum, to ``CAP`` at most, and are scaled by the root of both degrees."""
    both = None
    for e in edges:
        e = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        both = e if both is None else both.unionByName(e)
    one = both.groupBy("a", "b").agg(F.least(F.sum("w"), F.lit(CAP)).alias("w"))
    one = materialize(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    degree = materialize(one.groupBy("a").agg(F.count("*").alias("d")))
    return one.join(degree, "a").join(degree.selectExpr("a AS b", "d AS d2"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))


def mean_field(edges: DataFrame, pinned: DataFrame, beta: float = BETA, epsilon: float = EPSILON, sweeps: int = SWEEPS, damping: float = 0.5) -> DataFrame:
    """(item, spin): each item's expected spin given its neighbours', swept until the energy stands still.

    ``edges(a, b, w)`` hold both directions; a pinned item is drawn to ``s`` with
    strength ALPHA.  All items change at once, half way (``damping``) from the old
    spin to the new.
    """
    items = edges.select(F.col("a").alias("item")).union(pinned.select("item")).distinct()
    items = materialize(items.join(pinned.select("item", "s"), "item", "left"))
    edges = materialize(edges)
    state = materialize(items.select("item", "s", F.coalesce("s", F.lit(0.0)).alias("spin")))
    before = None
    for _ in range(sweeps):
        field = edges.join(state.select(F.col("item").alias("b"), "spin"), "b").groupBy(F.col("a").alias("item")).agg(F.sum(F.col("w") * F.col("spin")).alias("h"))
        new = state.join(field, "item", "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
        # spins are -1 and 1: the log odds of 1
        x = 2 * beta * F.col("h") - F.when(F.col("s").isNull(), 0.0).otherwise(ALPHA * (F.pow(1 - F.col("s"), 2) - F.pow(1 + F.col("s"), 2)))
        new = new.withColumn("spin", F.when(F.col("s").isNull(), damping * F.col("spin") + (1 - damping) * F.tanh(x / 2)).otherwise(F.tanh(x / 2))).withColumn("x", x)
        state = materialize(new)
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("x"), F.lit(700.0)), F.lit(-700.0))))
        entropy = lambda q: F.when(q > 0, q * F.log2(q)).otherwise(0.0)
        penalty = F.when(F.col("s").isNull(), 0.0).otherwise(p * F.pow(1 - F.col("s"), 2) + (1 - p) * F.pow(1 + F.col("s"), 2))
        energy = state.agg(F.sum(-F.col("spin") * F.col("h") * beta / 2 + entropy(p) + entropy(1 - p) + penalty)).first()[0] or 0.0
        state = state.select("item", "s", "spin")
        if before is not None and abs(before - energy) <= epsilon:
            break
        before = energy
    return state.select("item", "spin")


def spin_lexicon(net: Net, seeds: DataFrame, texts: DataFrame | None = None, pairs: DataFrame | None = None, patterns: dict[str, list[str]] | None = None, form2lemma: DataFrame | None = None, stop: DataFrame | None = None, n: int | None = None, **field) -> DataFrame:
    """Terms by the sign of their spin; seeds one above the largest and one below the least of the others."""
    parts = [relation_edges(net)]
    if texts is not None:
        parts.append(gloss_edges(net, texts, form2lemma, stop))
    if pairs is not None:
        parts.append(pairs.select("a", "b", F.col("w").cast("double").alias("w")))
    edges = materialize(network(*parts))
    value = F.when(F.col("polarity") == "positive", 1.0).when(F.col("polarity") == "negative", -1.0).otherwise(0.0)
    pinned = seeds.select(F.col("term").alias("item"), value.alias("s"))
    if patterns:
        items = edges.select(F.col("a").alias("item")).distinct().join(pinned, "item", "left_anti")
        hit = F.when(seed_match({"positive": patterns.get("positive", [])}, "item"), 1.0).when(seed_match({"negative": patterns.get("negative", [])}, "item"), -1.0)
        pinned = pinned.unionByName(items.select("item", hit.alias("s")).where("s IS NOT NULL"))
    found = mean_field(edges, pinned, **field).join(seeds.select(F.col("term").alias("item")), "item", "left_anti").where("NOT isnan(spin)")
    found = materialize(found)
    ends = found.agg((F.coalesce(F.max("spin"), F.lit(0.0)) + 1).alias("hi"), (F.coalesce(F.min("spin"), F.lit(0.0)) - 1).alias("lo"))  # one row
    own = seeds.where("polarity <> 'neutral'").crossJoin(F.broadcast(ends)).select("term", "polarity", F.when(F.col("polarity") == "positive", F.col("hi")).otherwise(F.col("lo")).alias("score"))
    new = found.where("spin <> 0").select(F.col("item").alias("term"), F.when(F.col("spin") > 0, "positive").otherwise("negative").alias("polarity"), F.col("spin").alias("score"))
    return top(own.unionByName(new), n)
