"""Cuts, spins and classifiers on small inputs with known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrow.operators import cuts, embed, evaluate, learned, methods, net, spin
from lexigrow.operators.net import Net

SEEDS = "term string, polarity string"


def test_max_flow_is_the_least_cut():
    rng = np.random.default_rng(4)
    for _ in range(40):
        nodes = [cuts.SOURCE, cuts.SINK, *"abcde"]
        edges = {(a, b): int(rng.integers(1, 6)) for a, b in itertools.permutations(nodes, 2) if rng.random() < 0.4}
        src, dst, cap = [a for a, _ in edges], [b for _, b in edges], list(edges.values())
        least = min(sum(w for (a, b), w in edges.items() if a in side and b not in side) for k in range(6) for s in itertools.combinations("abcde", k) for side in [{cuts.SOURCE, *s}])
        value, near, _ = cuts.max_flow(src, dst, cap)
        assert value == least == sum(w for (a, b), w in edges.items() if a in near and b not in near)


def test_min_cut_of_a_graph(spark):
    # two seeds a side, parallel edges from both to m: their capacities sum
    rows = [("s1", "m", 2), ("s2", "m", 3), ("m", "t1", 4), ("s1", "n", 1), ("n", "t2", 5), ("x", "m", 1), ("m", "s1", 2)]
    edges = spark.createDataFrame(rows, "src string, dst string, w long")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    value, cut, sides = cuts.min_cut(edges, node("s1", "s2"), node("t1", "t2"))
    assert value == 5
    assert ("m", "t1") in {tuple(r) for r in cut.collect()}
    side = {r["node"]: r["side"] for r in sides.collect()}
    assert side["m"] == 1 and side["t1"] == side["t2"] == 2 and "x" not in side
    value, cut, sides = cuts.min_cut(edges.where("src = 'x'"), node("s1"), node("t1"))
    assert value == 0 and cut.isEmpty() and {r["node"] for r in sides.collect()} == {"s1", "t1"}


def little_net(spark):
    return Net(
        spark.createDataFrame([(1, "adj"), (2, "adj"), (3, "adj"), (4, "adj")], "synid long, pos string"),
        spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("f", 3), ("g", 4)], "lexid string, synid long"),
        spark.createDataFrame([("a", "gut"), ("b", "fein"), ("c", "schlecht"), ("d", "mies"), ("e", "rot"), ("f", "blau"), ("g", "fein")], "lexid string, form string"),
        spark.createDataFrame([(4, 1, "has_hyponym")], "from_syn long, to_syn long, rel string"),
        spark.createDataFrame([("a", "c", "has_antonym"), ("b", "g", "has_participle")], "from_lex string, to_lex string, rel string"),
    )


def test_cut_lexicon_and_lexical_edges(spark):
    n = little_net(spark)
    seeds = spark.createDataFrame([("gut", "positive"), ("schlecht", "negative"), ("rot", "neutral")], SEEDS)
    got = {r["term"]: (r["polarity"], r["score"]) for r in cuts.cut_lexicon(n, seeds).collect()}
    assert got["fein"] == ("positive", 1.0) and got["mies"] == ("negative", -1.0) and "blau" not in got
    w = {(r["src"], r["dst"]): r["w"] for r in net.term_graph(n).collect()}
    # by synset, by the relation of synset 4, by the lexical relation
    assert w[("gut", "fein")] == 1 and w[("fein", "gut")] == 2 and w[("schlecht", "mies")] == 1


def test_spin_lexicon(spark):
    seeds = spark.createDataFrame([("gut", "positive"), ("schlecht", "negative"), ("rot", "neutral")], SEEDS)
    texts = spark.createDataFrame([(3, "def", "nicht mies")], "synid long, kind string, txt string")
    edges = {(r["a"], r["b"]): r["w"] for r in spin.gloss_edges(little_net(spark), texts).collect()}
    assert edges == {("rot", "mies"): -1.0, ("blau", "mies"): -1.0}
    pairs = spark.createDataFrame([("fein", "neu", 1), ("mies", "alt", 1)], "a string, b string, w int")
    got = {r["term"]: (r["polarity"], r["score"]) for r in spin.spin_lexicon(little_net(spark), seeds, texts, pairs, sweeps=30).collect()}
    assert got["fein"][0] == got["neu"][0] == "positive" and got["mies"][0] == got["alt"][0] == "negative"
    assert got["gut"][1] == pytest.approx(1 + max(s for t, (_, s) in got.items() if t not in ("gut", "schlecht")))


def messages(spark):
    rows = []
    for k in range(24):
        good = k % 3
        words = {0: ["gut", "schön", "fein"], 1: ["schlecht", "mies", "öde"], 2: ["rot", "tisch", "lampe"]}[good]
        rows += [(k, 0, i, w, w, "ADJD") for i, w in enumerate([*words, "heute"])]
    return spark.createDataFrame(rows, "doc_id long, sent_id long, pos int, form string, lemma string, tag string")


def test_margin_and_bag_lexicons(spark):
    seeds = spark.createDataFrame([("gut", "positive"), ("schlecht", "negative"), ("rot", "neutral")], SEEDS)
    for method in (learned.margin_lexicon, learned.bag_lexicon):
        got = {r["term"]: (r["polarity"], r["score"]) for r in method(messages(spark), seeds).collect()}
        assert got["schön"][0] == "positive" and got["mies"][0] == "negative" and got["mies"][1] < 0 < got["schön"][1]
        assert got["gut"][1] > 1e300 and "tisch" not in got
    # a message without seeds counts through an expression
    only = spark.createDataFrame([("schlecht", "negative"), ("rot", "neutral")], SEEDS)
    got = {r["term"]: r["polarity"] for r in learned.margin_lexicon(messages(spark), only, patterns={"positive": ["gu."], "negative": []}).collect()}
    assert got["schön"] == "positive"
    assert {r["term"] for r in learned.margin_lexicon(messages(spark).limit(0), seeds).collect()} == {"gut", "schlecht"}


def test_pmi_with_expressions(spark):
    only = spark.createDataFrame([("schlecht", "negative"), ("rot", "neutral")], SEEDS)
    got = {r["term"]: r["polarity"] for r in methods.pmi(messages(spark), only, patterns={"positive": ["gu."], "negative": []}).collect()}
    assert got["mies"] == "negative"


def test_softmax_lexicon_and_axis(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal((3, 0) if i % 3 == 0 else (-3, 0) if i % 3 == 1 else (0, 4), 0.3)]) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    seeds = spark.createDataFrame([(i, ("positive", "negative", "neutral")[i % 3]) for i in range(30)], "id long, polarity string")
    for found in (learned.softmax_lexicon(v, seeds), embed.pca_axis(v, seeds, 2)):
        got = {r["id"]: r["polarity"] for r in found.where("id >= 30").collect()}
        assert got and all(p == ("positive", "negative", "neutral")[i % 3] for i, p in got.items())
        assert sum(i % 3 < 2 for i in range(30, 90)) == len(got)
    # without seeds of one class nothing breaks
    assert embed.pca_axis(v, seeds.where("polarity = 'positive'"), 2).count() >= 0


def test_gloss_lexicon(spark):
    n = 8
    syn = [(k, "adj") for k in range(2 * n)]
    net_ = Net(
        spark.createDataFrame(syn, "synid long, pos string"),
        spark.createDataFrame([(f"l{k}", k) for k in range(2 * n)], "lexid string, synid long"),
        spark.createDataFrame([(f"l{k}", f"t{k}") for k in range(2 * n)], "lexid string, form string"),
        spark.createDataFrame([(0, 2, "has_hyponym")], "from_syn long, to_syn long, rel string"),
        spark.createDataFrame([("l0", "l1", "has_antonym")], "from_lex string, to_lex string, rel string"),
    )
    words = spark.createDataFrame([(k, w) for k in range(2 * n) for w in (["hell", "froh", f"x{k}"] if k % 2 == 0 else ["dunkel", "trüb", f"y{k}"])], "synid long, lemma string")
    seeds = spark.createDataFrame([("t0", "positive")], SEEDS)
    got = {r["term"]: (r["polarity"], r["score"]) for r in learned.gloss_lexicon(net_, words, seeds, steps=(0, 1)).collect()}
    # after a step t2 is positive and t1 negative; the others follow their glosses
    assert got["t0"] == ("positive", 2.0)
    assert all(got[f"t{k}"][0] == ("positive", "negative")[k % 2] for k in range(3, 2 * n))


def test_cardinality_search(spark):
    toks = messages(spark)
    lex = spark.createDataFrame([("gut", "positive", 3.0), ("mies", "negative", -2.0), ("tisch", "positive", 1.0)], "term string, polarity string, score double")
    gold = toks.where("lemma IN ('gut', 'mies')").select("doc_id", "sent_id", F.col("pos").alias("start"), F.col("pos").alias("end"), F.when(F.col("lemma") == "gut", "positive").otherwise("negative").alias("class"))
    out = {r["size"]: r for r in evaluate.cardinality_search(toks, lex, gold, [1, 2, 3]).collect()}
    for size in (1, 2, 3):
        hits = evaluate.match(toks, lex.orderBy(F.abs("score").desc()).limit(size))
        want = evaluate.pooled(evaluate.tally(toks, hits, gold)).first()
        assert out[size]["macro_f1"] == pytest.approx(want["macro_f1"])
    best = evaluate.running_best(evaluate.cardinality_search(toks, lex, gold, [1, 2, 3])).first()
    assert best["size"] == 2 and best["macro_f1"] == pytest.approx(1.0)
    table = evaluate.method_matrix(toks, gold, {"given": lambda s: lex}, {"none": None}, [1, 2]).collect()
    assert [(r["method"], r["size"]) for r in table] == [("given", 2)]


def test_agreement_by_file_and_emoticons(spark):
    a = spark.createDataFrame([("d1", "positive", [1, 2]), ("d2", "positive", [1])], "doc_id string, class string, ids array<int>")
    b = spark.createDataFrame([("d1", "positive", [2, 3]), ("d2", "positive", [5])], a.schema)
    sizes = spark.createDataFrame([("d1", 10), ("d2", 10)], "doc_id string, n long")
    rows = {r["doc_id"]: r for r in evaluate.overlap_by_file(a, b, sizes, "proportional").collect()}
    assert (rows["d1"]["t1"], rows["d1"]["o1"]) == (2, 1) and rows["d2"]["o1"] == 0
    one = evaluate.kappa(evaluate.overlap(a.where("doc_id = 'd1'"), b.where("doc_id = 'd1'"), "proportional"), 10).first()["kappa"]
    assert rows["d1"]["kappa"] == pytest.approx(one)
    words = spark.createDataFrame([("d1", 1, "sehr"), ("d1", 2, "gut"), ("d2", 1, ":-)")], "doc_id string, id int, word string")
    assert [r["doc_id"] for r in evaluate.without_emoticons(a, words).collect()] == ["d1"]


def test_lexicon_algebra(spark):
    row = lambda *r: spark.createDataFrame(list(r), SEEDS)
    x, y, z = row(("a", "positive"), ("n", "neutral")), row(("a", "positive"), ("m", "neutral")), row(("a", "positive"), ("n", "neutral"))
    assert {tuple(r) for r in methods.merge_three(x, y, z, intersect=True).collect()} == {("a", "positive"), ("n", "neutral")}
    assert ("m", "neutral") not in {tuple(r) for r in methods.merge_three(x, y, z).collect()}
    forms = spark.createDataFrame([("as", "a", "positive"), ("bs", "b", "positive")], "term string, lemma string, polarity string")
    assert {r["term"] for r in methods.extend_by_lemma(row(("a", "positive")), forms).collect()} == {"a", "as"}
    nodes = spark.createDataFrame([("a", "adj")], "form string, pos string")
    assert net.seed_values((nodes, 1), (nodes, -1)).first()["x"] == -1.0
    assert net.drawing(little_net(spark))[1].where("kind = 'antonym'").count() == 1


def test_word_vectors(spark):
    docs = spark.createDataFrame([(["a", "b", "c"] * 5,), (["a", "b"] * 5,)], "words array<string>")
    assert {r["word"] for r in embed.train_vectors(docs, dims=4).collect()} == {"a", "b", "c"}
