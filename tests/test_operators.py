"""Operators that SQL does not state, against brute force; hand-made cases of the others."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lexigrow.functions import text as T
from lexigrow.operators import corpus, embed, evaluate, methods, net
from lexigrow.operators.net import Net


def small_net(spark):
    return Net(
        spark.createDataFrame([(1, "adj"), (2, "adj"), (3, "nomen")], "synid long, pos string"),
        spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 2)], "lexid string, synid long"),
        spark.createDataFrame([("a", "good"), ("b", "fine"), ("c", "bad"), ("d", "day"), ("e", "fine")], "lexid string, form string"),
        spark.createDataFrame([(2, 3, "has_hyponym")], "from_syn long, to_syn long, rel string"),
        spark.createDataFrame([("a", "c", "antonym")], "from_lex string, to_lex string, rel string"),
    )


def test_breadth_first(spark):
    seeds = spark.createDataFrame([("good", "positive")], "term string, polarity string")
    got = {r["term"]: (r["polarity"], r["score"]) for r in methods.breadth_first(small_net(spark), seeds).collect()}
    # fine: a mate of good; bad: its antonym; day: what bad's and fine's synset leads to, positive first
    assert got == {"good": ("positive", 1.0), "fine": ("positive", 0.5), "bad": ("negative", 0.5), "day": ("positive", 0.25)}


def test_reachable_all_rounds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in net.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_best_paths(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 0.5), ("c", "a", 1.0)]
    got = methods.best_paths(spark.createDataFrame(edges, "i string, j string, w double"), spark.createDataFrame([("a", "positive")], "term string, polarity string"), 2)
    want = {}
    for k in range(3):
        for path in itertools.product("abc", repeat=k):
            at, total, ok = "a", 0.0, True
            for n in path:
                w = {(i, j): w for i, j, w in edges}.get((at, n))
                ok, at, total = ok and w is not None, n, total + (w or 0)
            if ok:
                want[at] = max(want.get(at, 0.0), total)
    assert {r["term"]: r["best"] for r in got.collect()} == want


def test_prune_keeps_ties_and_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    m = np.triu(rng.integers(0, 4, (7, 7)))
    m = m + m.T
    cells = [(f"w{i}", f"w{j}", int(m[i, j])) for i in range(7) for j in range(7) if m[i, j]]
    got = {(r["i"], r["j"]) for r in corpus.prune(spark.createDataFrame(cells, "a string, b string, n long"), top=2).collect()}
    dots, want = m @ m.T, set()
    for i in range(7):
        stored = [j for j in range(7) if m[i, j]]
        if stored:
            cut = sorted((dots[i, j] for j in stored), reverse=True)[:2][-1]
            want |= {(f"w{i}", f"w{j}") for j in stored if dots[i, j] >= cut}
    assert got == want


def test_spins_follow_their_neighbours(spark):
    edges = spark.createDataFrame([("p", "x", 1.0), ("n", "y", 1.0)], "a string, b string, w double")
    pinned = spark.createDataFrame([("p", 1.0), ("n", -1.0)], "item string, s double")
    got = {r["item"]: r["spin"] for r in methods.spins(edges, pinned, 2).collect()}
    assert got["p"] == 1 and np.isclose(got["x"], np.tanh(0.8)) and np.isclose(got["y"], -np.tanh(0.8))


def test_least_squares_and_pca(spark):
    rng = np.random.default_rng(0)
    x, m = rng.normal(size=(30, 3)), rng.normal(size=(3, 3))
    frame = lambda a: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "id long, v array<double>")
    assert np.allclose(embed.least_squares(frame(x), frame(x @ m)), m)
    axes, mean = embed.pca(frame(x), 3)
    _, s, _ = np.linalg.svd(x - x.mean(0))
    turned = np.array([r["v"] for r in embed.rotate(frame(x), axes, mean).orderBy("id").collect()])
    assert np.allclose((turned**2).sum(0), s**2) and np.allclose(mean, x.mean(0))


def test_polarity_line(spark):
    v = spark.createDataFrame([(0, [5.0, 0.0]), (1, [6.0, 0.1]), (2, [-5.0, 0.0]), (3, [-4.0, 0.2])], "id long, v array<double>")
    seeds = spark.createDataFrame([(0, "positive"), (1, "positive"), (2, "negative"), (3, "negative")], "id long, polarity string")
    line = embed.polarity_line(v, seeds)
    assert abs(line[0]) > 0.99


def test_align_against_brute_force():
    def best(a, b):
        if not a or not b:
            return -2 * (len(a) + len(b))
        return max(best(a[:-1], b[:-1]) + (2 if a[-1] == b[-1] else -1), best(a[:-1], b) - 2, best(a, b[:-1]) - 2)

    for a, b in [("AGTACGCA", "TCGC"), ("", "AB"), ("AB", ""), ("A", "A"), ("ABC", "ABC")]:
        got = evaluate.align(list(a), list(b))
        used = [j for js in got for j in js]
        assert used == sorted(set(used))
        value = sum((2 if a[i] in {b[j] for j in js} else -1) - 2 * (len(js) - 1) if js else -2 for i, js in enumerate(got)) - 2 * (len(b) - len(used))
        assert value <= best(a, b) or not b
    assert evaluate.align(list("AB"), list("AB")) == [[0], [1]]


def test_spans_and_words(spark):
    df = spark.createDataFrame([("word_3..word_5,word_9",), ("word_1",)], "s string")
    rows = df.select(T.span_to_ids(F.col("s")).alias("ids"), T.ids_to_span(T.span_to_ids(F.col("s"))).alias("back"), "s").collect()
    assert rows[0]["ids"] == [3, 4, 5, 9] and all(r["back"] == r["s"] for r in rows)
    words = spark.createDataFrame([("ok-x",), ("grün",), ("a b",)], "w string").select(T.check_word(F.col("w")).alias("c")).collect()
    assert [r["c"] for r in words] == [True, False, False]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    toks = corpus.kept(corpus.tokens(docs))
    seeds = spark.createDataFrame([("good", "positive")], "term string, polarity string")
    assert [r["term"] for r in methods.pmi(toks, seeds).collect()] == ["good"]
    assert corpus.context_pairs(toks).isEmpty() and evaluate.match(toks, seeds).isEmpty()
