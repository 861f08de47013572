"""Lexicon induction: every method returns (term, polarity, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED_SCORE, argmax_abs, broadcast_if_small, materialize, numbered, strongest_first, top
from .corpus import message_classes, seed_match
from .net import ANTONYM, SYNONYM, Net, coded, coded_graph, coded_matrix, prune_normalize, seed_nodes

THRESHOLD = 0.5
#: Seeds whose best paths a row holds together.
SEEDS_AT_ONCE = 32


def default_lexicon(seeds: DataFrame) -> DataFrame:
    """Seeds with scores 1 and -1; neutral ones are left out."""
    return strongest_first(seeds.where("polarity <> 'neutral'").select("term", "polarity", F.when(F.col("polarity") == "positive", 1.0).otherwise(-1.0).alias("score")))


def seed_rows(seeds: DataFrame) -> DataFrame:
    """The certain entries: seeds with plus or minus the largest double."""
    return seeds.where("polarity <> 'neutral'").select("term", "polarity", F.when(F.col("polarity") == "positive", SEED_SCORE).otherwise(-SEED_SCORE).alias("score"))


def _signed(v: Column) -> Column:
    return F.when(v > 0, "positive").otherwise("negative")


def pmi(toks: DataFrame, seeds: DataFrame, n: int | None = None, least: int = 4, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """Pointwise association of words with messages that hold a seed.

    A message has the class of the first of positive, negative, neutral seeds
    that it holds, or whose expression (``patterns``) matches it.  A term is subjective if its log ratio is over zero; its
    polarity is that of the log ratio of positive to negative messages; its score
    their sum.  An empty ratio counts as 1.  Seeds come with the largest doubles.
    """
    words = toks.select("doc_id", F.col("lemma").alias("term")).distinct()
    # computed once: the words of a message are counted by its class
    words = materialize(words)
    messages = materialize(message_classes(words, seeds, patterns))
    names = ("positive", "negative", "neutral")
    of = lambda k: F.count(F.when(F.col("class") == names[k], 1))
    totals = messages.agg(of(0).alias("np"), of(1).alias("nn"), of(2).alias("nu"))  # one row
    stat = words.join(messages, "doc_id").groupBy("term").agg(of(0).alias("p"), of(1).alias("n"), of(2).alias("u")).where(F.col("p") + F.col("n") + F.col("u") >= least)
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    ratio = lambda a, b: F.log2(one(a.cast("double") / one(b.cast("double"))))
    s = stat.join(seeds, "term", "left_anti").crossJoin(F.broadcast(totals))
    s = s.withColumn("subj", ratio((F.col("p") + F.col("n")) * F.col("nu"), F.col("u") * (F.col("np") + F.col("nn")))).where("subj > 0")
    s = s.withColumn("pol", ratio(F.col("p") * F.col("nn"), F.col("n") * F.col("np")))
    return top(s.select("term", _signed(F.col("pol")).alias("polarity"), (F.col("pol") + F.abs("subj")).alias("score")).unionByName(seed_rows(seeds)), n)


# --- signed propagation over a net ---------------------------------------------


def held_cells(cells: DataFrame) -> DataFrame:
    """Cells that every round reads: computed once, then kept in columns; the caller lets them go."""
    return materialize(cells).persist()


def matvec(cells: DataFrame, v: DataFrame, *xs: str) -> DataFrame:
    """(k, x...): the sums over j of w * x of ``cells(i, j, w)`` and ``v(k, x...)``; no cell is shuffled where the vector is small."""
    xs = xs or ("x",)
    right = broadcast_if_small(v.select(F.col("k").alias("j"), *xs))
    return cells.join(right, "j").groupBy(F.col("i").alias("k")).agg(*[F.sum(F.col("w") * F.col(x)).alias(x) for x in xs])


def clamp(v: DataFrame, seeds: DataFrame) -> DataFrame:
    """Positive seeds at least 1, negative ones at most -1, neutral ones 0; seeds that a round lost come back."""
    x = F.coalesce("x", F.lit(0.0))
    held = F.when(F.col("polarity") == "positive", F.greatest(x, F.lit(1.0))).when(F.col("polarity") == "negative", F.least(x, F.lit(-1.0))).when(F.col("polarity") == "neutral", 0.0).otherwise(x)
    return v.join(seeds.select("k", "polarity"), "k", "full").select("k", held.alias("x"))


def matrix_propagation(net: Net, seeds: DataFrame, rounds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Repeated products of the signed term matrix with the clamped seed vector."""
    c = coded(net)
    nodes = materialize(c.numbers(c.names.select("form", "pos").join(seeds.withColumnRenamed("term", "form"), "form")))
    cells = held_cells(coded_matrix(c))
    v = clamp(nodes.select("k", F.lit(0.0).alias("x")), nodes)
    for _ in range(rounds):
        v = materialize(clamp(matvec(cells, v), nodes))
    cells.unpersist()
    ends = v.agg(F.max("x").alias("hi"), F.min("x").alias("lo"))  # one row
    x = F.when(F.col("polarity") == "positive", F.col("hi") + 1).when(F.col("polarity") == "negative", F.col("lo") - 1).otherwise(F.col("x"))
    out = v.join(nodes, "k", "left").crossJoin(F.broadcast(ends)).withColumn("score", x).where(F.abs("score") >= threshold)
    return strongest_first(argmax_abs(c.named(out, k="form").select("form", "pos", _signed(F.col("score")).alias("polarity"), "score")))


def label_propagation(net: Net, seeds: DataFrame, rounds: int = 300, tolerance: bool = True) -> DataFrame:
    """Class masses spread over the column-normalised matrix, seeds pinned, rows normalised, until they stand still."""
    c = coded(net)
    nodes = materialize(c.numbers(c.names.select("form", "pos").join(seeds.withColumnRenamed("term", "form"), "form")))
    cells = held_cells(prune_normalize(materialize(coded_matrix(c))))
    hot = [F.when(F.col("polarity") == k, 1.0).otherwise(0.0) for k in ("positive", "negative", "neutral")]
    pinned = lambda rows, y: rows.join(nodes, "k", "left").select("k", *[F.when(F.col("polarity").isNull(), y(n)).otherwise(h).alias(f"y{n}") for n, h in enumerate(hot)])
    y = materialize(pinned(c.names.select("k"), lambda n: F.lit(float(n == 2))))
    for _ in range(rounds):
        new = pinned(matvec(cells, y, "y0", "y1", "y2"), lambda n: F.col(f"y{n}"))
        total = F.col("y0") + F.col("y1") + F.col("y2")
        new = materialize(new.select("k", *[(F.col(f"y{n}") / F.when(total == 0, 1.0).otherwise(total)).alias(f"y{n}") for n in range(3)]))
        if tolerance:
            off = " OR ".join(f"abs(a.y{n} - b.y{n}) > 1e-8 + 1e-5 * abs(b.y{n})" for n in range(3))
            moved = new.alias("a").join(y.alias("b"), "k").where(off)
            y = new
            if moved.isEmpty():
                break
        y = new
    cells.unpersist()
    r = [F.round(f"y{n}", 9) for n in range(3)]
    label = F.when((r[0] >= r[1]) & (r[0] >= r[2]), "positive").when(r[1] >= r[2], "negative")
    out = c.named(y.withColumn("polarity", label).where("polarity IS NOT NULL"), k="form")
    return strongest_first(argmax_abs(out.select("form", "pos", "polarity", F.when(F.col("polarity") == "positive", F.col("y0")).otherwise(F.col("y1")).alias("score"))))


def random_walk(net: Net, seeds: DataFrame, steps: int = 17, teleport: float = 0.0, threshold: float = THRESHOLD) -> DataFrame:
    """Expected seed value of a walk of at most ``steps`` steps: exact, by an absorbing chain."""
    c = coded(net)
    value = F.when(F.col("polarity") == "positive", 1.0).when(F.col("polarity") == "negative", -1.0).otherwise(0.0)
    pinned = materialize(c.numbers(c.names.select("form", "pos").join(seeds.withColumnRenamed("term", "form"), "form")).select("k", value.alias("x")))
    graph = materialize(coded_graph(c))
    share = broadcast_if_small(graph.groupBy("i").agg(F.sum("w").alias("_s")))
    p = graph.join(broadcast_if_small(pinned.selectExpr("k AS i")), "i", "left_anti").join(share, "i").select("i", "j", (F.col("w") / F.col("_s") * (1 - teleport)).alias("w"))
    p = held_cells(p)
    v = pinned
    for _ in range(steps):
        v = materialize(matvec(p, v).unionByName(pinned))
    p.unpersist()
    out = c.named(v.where(F.abs("x") > threshold), k="form")
    return strongest_first(argmax_abs(out.select("form", "pos", _signed(F.col("x")).alias("polarity"), F.col("x").alias("score"))))


def bayes(net: Net, seeds: DataFrame) -> DataFrame:
    """hits * prior / seed synsets by class, the first of the largest counts; seeds with the largest doubles."""
    m = net.members()
    nodes = seed_nodes(net, seeds).groupBy("polarity").agg(F.countDistinct("form", "pos").alias("seeds"))
    z = net.terms().agg(F.count("*").alias("z"))  # one row
    syn = m.join(seeds.withColumnRenamed("term", "form"), "form").select("synid", "polarity").distinct()
    size = syn.groupBy("polarity").agg(F.count("*").alias("synsets"))  # three rows
    factor = nodes.join(size, "polarity").crossJoin(F.broadcast(z)).select("polarity", (F.col("seeds") / F.col("z") / F.col("synsets")).alias("f"))
    hits = m.select("synid", "form", "pos").distinct().join(syn, "synid").groupBy("form", "pos", "polarity").agg(F.count("*").alias("hits"))
    s = hits.join(F.broadcast(factor), "polarity").withColumn("score", F.col("hits") * F.col("f"))
    order = F.when(F.col("polarity") == "positive", 0).when(F.col("polarity") == "negative", 1).otherwise(2)
    best = s.groupBy("form", "pos").agg(F.min_by(F.struct("polarity", "score"), F.struct(-F.round("score", 15), order)).alias("b")).select("form", "pos", "b.*")
    out = argmax_abs(best.where("polarity <> 'neutral' AND score > 0")).join(seeds.where("polarity <> 'neutral'").select("term"), "term", "left_anti")
    return strongest_first(out.unionByName(seed_rows(seeds)))


def breadth_first(net: Net, seeds: DataFrame, rounds: int | None = None, ext_rel: bool = True) -> DataFrame:
    """Polarity spreads round by round, at weight 2 ** -round.

    Synset mates whose synsets all have the source's part of speech take the
    polarity, with ``ext_rel`` also the targets of synonym-like relations;
    antonyms take the opposite, but neutral never flips.  Within a round positive
    beats negative beats neutral.
    """
    m = materialize(net.members())
    one_pos = m.groupBy("form").agg(F.countDistinct("pos").alias("k")).where("k = 1").select("form")
    a, b = m.selectExpr("synid", "lexid AS la", "form AS src"), m.selectExpr("synid", "lexid AS lb", "form AS dst")
    same = a.join(b, "synid").where("src <> dst").join(one_pos.withColumnRenamed("form", "dst"), "dst", "left_semi").select("src", "dst", F.lit(1).alias("sign"))
    if ext_rel:
        rel = net.con_rel.where(F.col("rel").isin(*SYNONYM)).selectExpr("from_syn AS synid", "to_syn")
        same = same.unionByName(a.join(rel, "synid").join(b.selectExpr("synid AS to_syn", "dst"), "to_syn").where("src <> dst").select("src", "dst", F.lit(1).alias("sign")))
    anti = net.lex_rel.where(F.col("rel").isin(*ANTONYM)).join(a.selectExpr("la AS from_lex", "src"), "from_lex").join(b.selectExpr("lb AS to_lex", "dst"), "to_lex").select("src", "dst", F.lit(-1).alias("sign"))
    edges = materialize(same.unionByName(anti).distinct())
    rank = F.when(F.col("polarity") == "positive", 0).when(F.col("polarity") == "negative", 1).otherwise(2)
    names = F.when(F.col("k") == 0, "positive").when(F.col("k") == 1, "negative").otherwise("neutral")
    first = m.select("form").distinct().join(seeds.withColumnRenamed("term", "form"), "form").groupBy("form").agg(F.min(rank).alias("k"))
    known = materialize(first.select("form", names.alias("polarity"), F.lit(0).alias("round")))
    front, r = known, 0
    while rounds is None or r < rounds:
        r += 1
        flipped = F.when((F.col("sign") < 0) & (F.col("polarity") == "positive"), 1).when((F.col("sign") < 0) & (F.col("polarity") == "negative"), 0).otherwise(rank)
        new = front.join(edges, front.form == edges.src).select(F.col("dst").alias("form"), flipped.alias("k")).groupBy("form").agg(F.min("k").alias("k"))
        front = materialize(new.join(known, "form", "left_anti").select("form", names.alias("polarity"), F.lit(r).alias("round")))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    out = known.where("polarity <> 'neutral'")
    return out.select(F.col("form").alias("term"), "polarity", F.pow(F.lit(2.0), -F.col("round")).alias("score")).orderBy(F.desc("score"), "term")


def best_paths(cooc: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(seed, term, best): per seed the largest sum of weights along at most ``rounds`` edges of ``cooc(i, j, w)``.

    Words are numbers, and a row holds a word's sums for ``SEEDS_AT_ONCE`` seeds, so
    that a round meets each edge once for all of them.
    """
    starts = sorted(r["term"] for r in seeds.select("term").distinct().where("term IS NOT NULL").collect())  # the seeds
    spark = cooc.sparkSession
    first = spark.createDataFrame([(x,) for x in starts], "term string")
    words = cooc.select(F.explode(F.array("i", "j")).alias("term")).union(first).distinct()
    names = materialize(numbered(words, "k").select("term", F.col("k").cast("long").alias("k")))
    name = broadcast_if_small(names)
    edges = materialize(cooc.join(name.selectExpr("term AS i", "k AS a"), "i").join(name.selectExpr("term AS j", "k AS b"), "j").select("a", "b", F.col("w").cast("double").alias("w")))
    out = spark.createDataFrame([], "seed string, term string, best double")
    for at in range(0, len(starts), SEEDS_AT_ONCE):
        some = starts[at : at + SEEDS_AT_ONCE]
        sums = [f"b{n}" for n in range(len(some))]
        best = materialize(name.where(F.col("term").isin(some)).select("k", *[F.when(F.col("term") == x, 0.0).alias(c) for x, c in zip(some, sums)]))
        for _ in range(rounds):
            step = edges.join(broadcast_if_small(best), F.col("a") == F.col("k")).select(F.col("b").alias("k"), *[(F.col(c) + F.col("w")).alias(c) for c in sums])
            best = materialize(best.unionByName(step).groupBy("k").agg(*[F.max(c).alias(c) for c in sums]))
        each = F.array(*[F.struct(F.lit(x).alias("seed"), F.col(c).alias("best")) for x, c in zip(some, sums)])
        out = out.unionByName(best.join(name, "k").select("term", F.inline(each)).where("best IS NOT NULL").select("seed", "term", "best"))
    return out


def path_lexicon(cooc: DataFrame, seeds: DataFrame, rounds: int = 20, n: int | None = None, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """Score = positive sum less beta times the negative, beta the ratio of both totals; words that an expression matches are seeds."""
    cooc = materialize(cooc)
    if any((patterns or {}).values()):
        words = cooc.select(F.col("i").alias("term")).distinct().join(seeds, "term", "left_anti")
        hit = F.when(seed_match({"p": patterns.get("positive", [])}, "term"), "positive").when(seed_match({"n": patterns.get("negative", [])}, "term"), "negative")
        seeds = materialize(seeds.unionByName(words.select("term", hit.alias("polarity")).where("polarity IS NOT NULL")))
    found = best_paths(cooc, seeds.where("polarity <> 'neutral'"), rounds).join(seeds.selectExpr("term AS seed", "polarity"), "seed")
    of = lambda k: F.sum(F.when(F.col("polarity") == k, F.col("best")).otherwise(0.0))
    s = materialize(found.groupBy("term").agg(of("positive").alias("p"), of("negative").alias("n")))
    beta = s.agg((F.sum("p") / F.sum("n")).alias("beta"))  # one row
    score = F.col("p") - F.coalesce("beta", F.lit(0.0)) * F.col("n")
    out = s.join(seeds, "term", "left_anti").crossJoin(F.broadcast(beta)).select("term", score.alias("score")).where("score <> 0")
    return top(out.select("term", _signed(F.col("score")).alias("polarity"), "score").unionByName(seed_rows(seeds)), n)


def spins(edges: DataFrame, pinned: DataFrame, sweeps: int = 10, beta: float = 0.8) -> DataFrame:
    """(item, spin): mean-field spins by synchronous sweeps over symmetric ``edges(a, b, w)``; ``pinned(item, s)`` stay."""
    both = edges.select("a", "b", "w").union(edges.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    scaled = materialize(both.join(degree, "a").join(degree.selectExpr("a AS b", "d AS d2"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w")))
    v = pinned.selectExpr("item", "s AS spin")
    for _ in range(sweeps):
        field = scaled.join(v, scaled.b == v.item).groupBy("a").agg(F.sum(F.col("w") * F.col("spin")).alias("h"))
        new = field.join(pinned, field.a == pinned.item, "left_anti").select(F.col("a").alias("item"), F.tanh(beta * F.col("h")).alias("spin"))
        v = materialize(new.unionByName(pinned.selectExpr("item", "s AS spin")))
    return v


# --- lexicon algebra -------------------------------------------------------------


def union(*lexicons: DataFrame) -> DataFrame:
    out = lexicons[0].select("term", "polarity")
    for other in lexicons[1:]:
        out = out.union(other.select("term", "polarity"))
    return out.distinct()


def intersection(*lexicons: DataFrame) -> DataFrame:
    out = lexicons[0].select("term", "polarity").distinct()
    for other in lexicons[1:]:
        out = out.join(other.select("term", "polarity"), ["term", "polarity"], "left_semi")
    return out


def merge_three(first: DataFrame, second: DataFrame, third: DataFrame, intersect: bool = False) -> DataFrame:
    """Union or intersection of three lexicons by class; neutral terms come from the first and the third, as the second has none."""
    polar = [x.where("polarity <> 'neutral'") for x in (first, second, third)]
    neutral = [x.where("polarity = 'neutral'") for x in (first, third)]
    how = intersection if intersect else union
    return how(*polar).unionByName(how(*neutral))


def extend_by_lemma(common: DataFrame, forms: DataFrame) -> DataFrame:
    """The intersection and those of ``forms(term, lemma, polarity)`` whose lemma it has."""
    return common.select("term", "polarity").union(forms.join(common.selectExpr("term AS lemma", "polarity"), ["lemma", "polarity"], "left_semi").select("term", "polarity")).distinct()


def prefix_sizes(lexicon: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, polarity, n): the make-up of the ``size`` strongest entries, all sizes in one pass over the ranks."""
    ranked = lexicon.orderBy(F.abs("score").desc(), "term").limit(max(sizes)).withColumn("r", F.row_number().over(Window.orderBy(F.abs("score").desc(), "term")))
    return ranked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("r <= size").groupBy("size", "polarity").agg(F.count("*").alias("n"))
