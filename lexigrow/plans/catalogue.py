"""All queries of the lexicon operators, each with its SQL twin where SQL can state it.

``tests`` hold the others against brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import corpus, cuts, embed, evaluate, learned, methods, spin
from ..operators import net as N
from ..operators.common import argmax_abs, materialize
from . import bindings as B
from .oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def kept(s: SparkSession, d: str) -> DataFrame:
    return corpus.kept(B.tokens(s, d))


def texts(s: SparkSession, d: str) -> DataFrame:
    return corpus.texts(B.read(s, d, "documents").select("doc_id", "text"))


# --- tokens -------------------------------------------------------------------


@query
def normalize_tokens(s, d):
    return B.tokens(s, d).groupBy("lemma").agg(F.count("*").alias("n"))


@query
def check_word_filter(s, d):
    return B.tokens(s, d).where(T.check_word(F.col("lemma"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def tag_filter(s, d):
    return kept(s, d).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query
def form2lemma_join(s, d):
    """Forms ending in s are lemmatised without it."""
    toks = B.tokens(s, d)
    pairs = toks.where(F.col("form").endswith("s")).select("form", F.expr("substring(lemma, 1, length(lemma) - 1)").alias("lemma")).distinct()
    return corpus.lemmatize(toks, pairs).groupBy("lemma").agg(F.count("*").alias("n"))


@query
def stopword_prune(s, d):
    toks = B.tokens(s, d)
    stop = toks.groupBy("form").agg(F.count("*").alias("n")).where("n >= 500")
    return corpus.lemmatize(toks, toks.select("form", "lemma").limit(0), stop).where("lemma IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def message_sessionise(s, d):
    """Units of a conversation begin at user turns."""
    rows = B.read(s, d, "conversations").withColumn("k", F.struct("turn", "role", "text"))
    return corpus.sessionise(rows, F.col("role") == "user", "conv_id", "k").groupBy("conv_id", "unit").agg(F.count("*").alias("n"))


@query
def word_count_min4(s, d):
    return corpus.word_counts(kept(s, d))


@query
def bigrams(s, d):
    return corpus.text_pairs(texts(s, d), 1).select(F.col("a").alias("prev"), F.col("b").alias("lemma"), "n")


@query
def feature_df(s, d):
    return corpus.text_feature_df(texts(s, d))


@query
def context_pairs(s, d):
    return corpus.text_pairs(texts(s, d)).where("n >= 2")


def _cooc(s, d):
    return corpus.cooccurrence(corpus.text_pairs(texts(s, d)), corpus.word_counts(kept(s, d)))


@query
def cooc_symmetric(s, d):
    return _cooc(s, d)


@query
def cooc_prune_top25(s, d):
    return r6(corpus.prune(materialize(_cooc(s, d))), "w")


@query
def negation_scope(s, d):
    return corpus.negation_scope(B.tokens(s, d), ("nicht", "not", "pas", "no")).groupBy("doc_id").agg(F.sum("weight").alias("weight"))


@query
def label_lines(s, d):
    return corpus.label_lines(B.read(s, d, "documents"), *map(list, B.WORDS.values()))


@query
def gloss_tfidf(s, d):
    return r6(corpus.tfidf(kept(s, d)), "w")


@query
def rocchio_scores(s, d):
    kind = F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "negative").otherwise("neutral")
    w = materialize(corpus.tfidf(kept(s, d)))
    return r6(corpus.rocchio(w, B.read(s, d, "labels").select("doc_id", kind.alias("class"))), "p")


# --- lexicons -------------------------------------------------------------------


@query
def lexicon_pmi(s, d):
    return methods.pmi(kept(s, d), B.word_seeds(s)).withColumn("score", F.when(F.abs("score") < 1e300, F.round("score", 6)).otherwise(F.col("score")))


@query
def lexicon_default(s, d):
    return methods.default_lexicon(B.word_seeds(s))


@query
def lexicon_topn(s, d):
    return r6(methods.pmi(kept(s, d), B.word_seeds(s)).where("abs(score) < 1e300").withColumn("score", F.round("score", 6)).orderBy(F.abs("score").desc(), "term").limit(100), "score")


@query
def cardinality_sweep(s, d):
    found = methods.pmi(kept(s, d), B.word_seeds(s)).where("abs(score) < 1e300").withColumn("score", F.round("score", 6))
    return methods.prefix_sizes(found, [40, 60, 80, 100, 120, 140, 160])


@query
def lexicon_best_path(s, d):
    cells = corpus.prune(materialize(_cooc(s, d)))
    out = methods.path_lexicon(cells, B.word_seeds(s)).where("abs(score) < 1e300")
    return r6(out, "score")


def _top_words(s, d, lang):
    docs = B.read(s, d, "documents").where(F.col("lang") == lang).select("doc_id", "text")
    n = corpus.kept(corpus.tokens(docs)).groupBy(F.col("lemma").alias("term")).agg(F.count("*").alias("n"))
    best = n.orderBy(F.desc("n"), "term").limit(200)
    return best.select("term", F.when(F.col("n") % 2 == 0, "positive").otherwise("negative").alias("polarity"), F.col("n").cast("double").alias("score"))


@query
def lexicon_union(s, d):
    return methods.union(*[_top_words(s, d, k) for k in ("en", "de", "fr")])


@query
def lexicon_intersect(s, d):
    return methods.intersection(*[_top_words(s, d, k) for k in ("en", "de")])


@query
def lexicon_argmax_abs(s, d):
    rows = None
    for k in ("en", "de", "fr"):
        one = _top_words(s, d, k).select(F.col("term").alias("form"), F.lit(k).alias("pos"), "polarity", "score")
        rows = one if rows is None else rows.unionByName(one)
    return argmax_abs(rows)


# --- the net --------------------------------------------------------------------


@query
def net_terms(s, d):
    return B.net(s, d).terms()


@query
def seed_nodes(s, d):
    return N.seed_nodes(B.net(s, d), B.net_seeds(s, d))


@query
def seed_synsets(s, d):
    return N.seed_synsets(B.net(s, d), B.net_seeds(s, d))


@query
def seed_cross_pos(s, d):
    return N.cross_pos(B.net_seeds(s, d), ["adj", "nomen", "verben"])


@query
def term_graph(s, d):
    return N.term_graph(B.net(s, d))


@query
def transition_prob(s, d):
    return r6(N.net_transition(B.net(s, d)).drop("w"), "p", "cum_p")


@query
def mean_degree(s, d):
    return r6(N.mean_degree(N.term_graph(B.net(s, d))), "mean_degree")


@query
def signed_matrix(s, d):
    return N.signed_matrix(B.net(s, d))


def _reached(s, d, rounds=None):
    con = B.net(s, d).con_rel
    first = con.select(F.col("from_syn").alias("node")).join(con.select(F.col("to_syn").alias("node")), "node", "left_anti")
    return N.reachable(con.selectExpr("from_syn AS src", "to_syn AS dst"), first, rounds)


@query
def reachability(s, d):
    """Orders of one customer within 6 steps of the customer's first, as its SQL bounds them; ``reachability_all`` has all."""
    return _reached(s, d, 6)


@query
def reachability_all(s, d):
    """Orders of one customer that can be reached from the customer's first, however far."""
    return _reached(s, d)


@query
def lexicon_bfs(s, d):
    return methods.breadth_first(B.net(s, d), B.net_seeds(s, d))


@query
def lexicon_matvec(s, d):
    return r6(methods.matrix_propagation(B.net(s, d), B.net_seeds(s, d), rounds=5).where("abs(score) < 1e300"), "score").select("term", "polarity", F.round("score", 4).alias("score"))


@query
def lexicon_label_prop(s, d):
    return r6(methods.label_propagation(B.net(s, d), B.net_seeds(s, d), rounds=4, tolerance=False), "score")


@query
def lexicon_label_prop_full(s, d):
    """Until the masses stand still; the SQL of ``lexicon_label_prop`` unrolls 4 rounds."""
    return r6(methods.label_propagation(B.net(s, d), B.net_seeds(s, d)), "score")


@query
def lexicon_random_walk(s, d):
    return r6(methods.random_walk(B.net(s, d), B.net_seeds(s, d), steps=4, threshold=0.02), "score")


@query
def lexicon_random_walk_full(s, d):
    """All 17 steps; the SQL of ``lexicon_random_walk`` unrolls 4."""
    return r6(methods.random_walk(B.net(s, d), B.net_seeds(s, d)), "score")


@query
def lexicon_bayes(s, d):
    out = methods.bayes(B.net(s, d), B.net_seeds(s, d))
    return out.withColumn("score", F.when(F.abs("score") < 1e300, F.round("score", 12)).otherwise(F.col("score")))


@query
def lexicon_ising(s, d):
    net = B.net(s, d)
    m = net.members().select("synid", "form")
    edges = m.join(m.withColumnRenamed("form", "b"), "synid").where("form < b").groupBy(F.col("form").alias("a"), "b").agg(F.count("*").cast("double").alias("w"))
    pinned = B.net_seeds(s, d).select(F.col("term").alias("item"), F.when(F.col("polarity") == "positive", 1.0).when(F.col("polarity") == "negative", -1.0).otherwise(0.0).alias("s"))
    return r6(methods.spins(edges, pinned), "spin")


@query
def lexicon_spin(s, d):
    """The whole spin method, swept until the energy stands still."""
    return r6(spin.spin_lexicon(B.net(s, d), B.net_seeds(s, d)), "score")


@query
def lexicon_min_cut(s, d):
    return cuts.cut_lexicon(B.net(s, d), B.net_seeds(s, d))


# --- classifiers -------------------------------------------------------------------


@query
def lexicon_margin(s, d):
    return methods.strongest_first(learned.margin_lexicon(kept(s, d), B.word_seeds(s)))


@query
def lexicon_bag(s, d):
    return methods.strongest_first(learned.bag_lexicon(kept(s, d), B.word_seeds(s)))


@query
def lexicon_softmax(s, d):
    return learned.softmax_lexicon(B.vectors(s, d), B.vector_seeds(s, d))


# --- vectors ---------------------------------------------------------------------


@query
def vec_length_norm(s, d):
    v = B.vectors(s, d).withColumn("v", V.length_normalize(F.col("v")))
    return v.select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query
def vec_zscore(s, d):
    return embed.zscore(B.vectors(s, d)).select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query
def centroids(s, d):
    v = B.vectors(s, d).withColumn("polarity", B.vector_class(F.col("label")))
    return embed.centroids(v, "polarity").select("polarity", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query
def pairwise_distance(s, d):
    v = B.vectors(s, d).select("id", "v")
    q = v.join(B.vector_seeds(s, d), "id", "left_semi").selectExpr("id AS seed", "v AS sv")
    return embed.pair_distances(v, q, 5)


@query
def lexicon_nearest_centroid(s, d):
    return r6(embed.nearest_centroid(B.vectors(s, d), B.vector_seeds(s, d), rounds=1), "score")


@query
def lexicon_nearest_centroid_full(s, d):
    """Until no vector moves; the SQL of ``lexicon_nearest_centroid`` has one round."""
    return r6(embed.nearest_centroid(B.vectors(s, d), B.vector_seeds(s, d)), "score")


@query
def lexicon_knn(s, d):
    return r6(embed.knn(B.vectors(s, d), B.vector_seeds(s, d)), "score")


@query
def lexicon_pca_axis(s, d):
    return r6(embed.pca_axis(B.vectors(s, d), B.vector_seeds(s, d)), "score")


@query
def polarity_line(s, d):
    line = embed.polarity_line(B.vectors(s, d), B.vector_seeds(s, d))
    return B.vectors(s, d).select("id", F.round(F.abs(V.dot(F.col("v"), F.array(*map(F.lit, line.tolist())))), 6).alias("length"))


@query
def embedding_lstsq(s, d):
    """The map that takes each vector to its reversal: what is left over is 0."""
    v = B.vectors(s, d).select("id", "v")
    m = embed.least_squares(v, v.withColumn("v", F.reverse("v")))
    out = embed.rotate(v, m.T, m[0] * 0).join(v.selectExpr("id", "reverse(v) AS t"), "id")
    return out.select("id", F.round(V.squared_distance(F.col("v"), F.col("t")), 4).alias("residual"))


# --- evaluation --------------------------------------------------------------------


def _evaluated(s, d):
    toks = B.tokens(s, d)
    return toks, materialize(evaluate.match(toks, B.lexicon(s))), materialize(B.gold(toks, B.read(s, d, "labels")))


def _tally(s, d):
    return evaluate.tally(*_evaluated(s, d), once=corpus.once(B.read(s, d, "documents")))


@query
def lexicon_match(s, d):
    return evaluate.match(B.tokens(s, d), B.lexicon(s))


@query
def eval_tally(s, d):
    return _tally(s, d)


@query
def eval_prf_file(s, d):
    return r6(evaluate.scores(_tally(s, d), ["doc_id"]), "macro_p", "macro_r", "macro_f1", "micro_p", "micro_r", "micro_f1")


@query
def eval_prf_spread(s, d):
    out = evaluate.spread(evaluate.scores(_tally(s, d), ["doc_id"]))
    return r6(out, *out.columns)


@query
def eval_prf_pooled(s, d):
    out = evaluate.pooled(_tally(s, d))
    return r6(out, *out.columns)


@query
def corpus_diff(s, d):
    _, hits, gold = _evaluated(s, d)
    return evaluate.corpus_diff(hits, gold)


@query
def cardinality_search(s, d):
    """The best of the default lexicon's prefixes against the gold spans."""
    toks = B.tokens(s, d)
    lexicon = methods.default_lexicon(B.word_seeds(s))
    out = evaluate.cardinality_search(toks, lexicon, materialize(B.gold(toks, B.read(s, d, "labels"))), [2, 4, 6, 8], corpus.once(B.read(s, d, "documents")))
    return r6(evaluate.running_best(out), "macro_p", "macro_r", "macro_f1", "micro_p", "micro_r", "micro_f1")


def _agreement(scheme: str) -> Query:
    def run(s, d):
        toks = materialize(B.tokens(s, d))
        return r6(evaluate.kappa(evaluate.overlap(B.annotations(toks, 1), B.annotations(toks, 2), scheme), toks.count()), "kappa")

    return run


for _scheme in ("binary", "proportional", "exact"):
    QUERIES[f"agreement_{_scheme}"] = _agreement(_scheme)


@query
def align_sequences(s, d):
    """Each turn's words against the next turn's."""
    rows = B.read(s, d, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("a"))
    by = Window.partitionBy("conv_id").orderBy("turn", "a")
    pairs = rows.withColumn("b", F.lead("a").over(by)).where("b IS NOT NULL")
    return evaluate.align_columns(pairs, "a", "b").select("conv_id", "turn", F.size(F.filter("aligned", lambda x: F.size(x) > 0)).alias("n_aligned"))


# --- spans and tables ----------------------------------------------------------------


@query
def ids_to_span(s, d):
    ids = B.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("ids"))
    return ids.select("l_orderkey", T.ids_to_span(F.col("ids")).alias("span"))


@query
def span_to_ids(s, d):
    spans = ids_to_span(s, d)
    return spans.select("l_orderkey", F.explode(T.span_to_ids(F.col("span"))).alias("id"))


@query
def lookup_default(s, d):
    """Order classes by the customer's segment; 2 where the lookup has none."""
    known = B.read(s, d, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("k"))
    o = B.read(s, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(known, o.o_custkey == known.c_custkey, "left").select("o_orderkey", F.coalesce("k", F.lit(2)).alias("class"))


@query
def anti_enrich(s, d):
    """Customers without urgent orders, and not in the first nation, with their nation's name."""
    c = B.read(s, d, "customer").select("c_custkey", "c_nationkey")
    rest = c.join(B.read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").where("c_nationkey <> 0")
    return rest.join(B.read(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left").select("c_custkey", "n_name")


@query
def positional_zip(s, d):
    """Suppliers and customers of each nation joined by their rank."""

    def ranked(name, key, nation):
        rank = F.row_number().over(Window.partitionBy(nation).orderBy(key))
        return B.read(s, d, name).select(F.col(nation).alias("nation"), key, rank.alias("r"))

    return ranked("supplier", "s_suppkey", "s_nationkey").join(ranked("customer", "c_custkey", "c_nationkey"), ["nation", "r"]).select("nation", "r", "s_suppkey", "c_custkey")


@query
def sample_vectors(s, d):
    """The 100 vectors of least hash beside the seeds."""
    v = B.read(s, d, "embeddings").where("vec_id % 10 <> 0").select("vec_id", F.md5(F.col("vec_id").cast("string").cast("binary")).alias("h"))
    return v.orderBy("h", "vec_id").limit(100)
