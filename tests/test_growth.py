"""Steps whose rows grew faster than their input: what a plan makes, and the same results."""

import numpy as np
from pyspark.sql import functions as F

from lexigrow.operators import corpus, evaluate, methods, net


def nodes(plan):
    """The executed plan's nodes, through adaptive stages."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(x for p in inner for x in nodes(p))]


def made(df):
    """(node's name, rows) of every node of ``df`` once it has run that counts its rows."""
    df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    out = []
    for p in nodes(df._jdf.queryExecution().executedPlan()):
        rows = p.metrics().get("numOutputRows")
        if rows.isDefined():
            out.append((p.nodeName(), rows.get().value()))
    return out


def exchanges(df):
    df.collect()
    return [p.nodeName() for p in nodes(df._jdf.queryExecution().executedPlan()) if p.nodeName() == "Exchange"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_pruning_a_hub_makes_no_pairs_of_its_neighbours(spark):
    n = 600
    cells = [("hub", f"w{k}", 1 + k % 5) for k in range(n)] + [(f"w{k}", f"w{k + 1}", 1 + k % 3) for k in range(n - 1)] + [("hub", "hub", 4), ("w3", "w3", 2)]
    rows = spark.createDataFrame(cells, "a string, b string, n long")
    rows = rows.union(rows.where("a <> b").select("b", "a", "n"))
    names = ["hub", *(f"w{k}" for k in range(n))]
    m = np.zeros((n + 1, n + 1), np.int64)
    for r in rows.collect():
        m[names.index(r["a"]), names.index(r["b"])] = r["n"]
    dots, want = m @ m, set()
    for i in range(n + 1):
        stored = [j for j in np.flatnonzero(m[i]) if dots[i, j]]
        cut = sorted((dots[i, j] for j in stored), reverse=True)[: corpus.TOP][-1]
        want |= {(names[i], names[j], round(float(np.log1p(m[i, j])), 9)) for j in stored if dots[i, j] >= cut}
    found = corpus.prune(rows)
    assert {(r["i"], r["j"], round(r["w"], 9)) for r in found.collect()} == want
    assert max(k for _, k in made(found)) < 20 * rows.count()


def test_pairs_and_features_are_counted_where_texts_are_read(spark):
    texts = docs(spark, "Haus Baum Haus Tisch. Haus Baum\nStuhl", None, "", "Baum Haus. Straße Haus Baum Haus Baum Haus Baum Haus")
    toks = corpus.kept(corpus.tokens(texts))
    assert toks.where("lemma = 'strasse'").count() == 1
    sents = {}
    for r in toks.orderBy("doc_id", "sent_id", "pos").collect():
        sents.setdefault((r["doc_id"], r["sent_id"]), []).append(r["lemma"])
    pairs, df = {}, {}
    for ws in sents.values():
        for j, b in enumerate(ws):
            for a in ws[max(0, j - corpus.CONTEXT) : j]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for doc, feature in {(d, f) for (d, _), ws in sents.items() for f in [*ws, *map(" ".join, zip(ws, ws[1:]))]}:
        df[feature] = df.get(feature, 0) + 1
    for rows in (corpus.texts(texts), corpus.gathered(toks)):
        assert {(r["a"], r["b"]): r["n"] for r in corpus.text_pairs(rows).collect()} == pairs
        assert {r["feature"]: r["df"] for r in corpus.text_feature_df(rows, 1).collect()} == df
    # one shuffle, of counts
    assert len(exchanges(corpus.text_feature_df(corpus.texts(texts), 1))) == len(exchanges(corpus.text_pairs(corpus.texts(texts)))) == 1


def test_an_id_that_is_there_twice_is_one_text(spark):
    twice = docs(spark, "Haus Baum").union(spark.createDataFrame([(0, "Haus Haus")], "doc_id long, text string"))
    got = {r["feature"]: r["df"] for r in corpus.text_feature_df(corpus.texts(twice), 1).where(~F.col("feature").contains(" ")).collect()}
    assert got == {"haus": 1, "baum": 1}


def test_paths_of_all_seeds_share_a_row(spark, monkeypatch):
    rng = np.random.default_rng(9)
    edges = [(f"w{a}", f"w{b}", float(rng.integers(1, 9))) for a in range(12) for b in range(12) if a != b and rng.random() < 0.3]
    frame = spark.createDataFrame(edges, "i string, j string, w double")
    seeds = spark.createDataFrame([(f"w{k}", "positive") for k in range(5)] + [("absent", "negative")], "term string, polarity string")
    want = {(f"w{k}", f"w{k}"): 0.0 for k in range(5)} | {("absent", "absent"): 0.0}
    for _ in range(3):
        step = dict(want)
        for (s, t), x in want.items():
            for a, b, w in edges:
                if a == t:
                    step[s, b] = max(step.get((s, b), 0.0), x + w)
        want = step
    counts = []
    monkeypatch.setattr(methods, "materialize", lambda df, f=methods.materialize: [out := f(df), counts.append(out.count())][0])
    got = {(r["seed"], r["term"]): r["best"] for r in methods.best_paths(frame, seeds, 3).collect()}
    assert got == want and max(counts[2:]) <= 13
    monkeypatch.setattr(methods, "SEEDS_AT_ONCE", 2)
    assert {(r["seed"], r["term"]): r["best"] for r in methods.best_paths(frame, seeds, 3).collect()} == want


def test_a_round_shuffles_no_cells(spark):
    cells = spark.createDataFrame([(a, b, 0.5) for a in range(9) for b in range(9)], "i int, j int, w double")
    out = methods.matvec(cells, spark.createDataFrame([(k, float(k)) for k in range(9)], "k int, x double"))
    assert {r["k"]: r["x"] for r in out.collect()} == {k: 18.0 for k in range(9)}
    assert len(exchanges(out)) == 1


def test_pairs_of_terms_are_numbers_until_they_are_counted(spark, capsys):
    net_ = net.Net(
        spark.createDataFrame([(1, "adj"), (2, "adj")], "synid long, pos string"),
        spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "lexid string, synid long"),
        spark.createDataFrame([("a", "gut"), ("b", "fein"), ("c", "mies")], "lexid string, form string"),
        spark.createDataFrame([(2, 1, "has_hyponym")], "from_syn long, to_syn long, rel string"),
        spark.createDataFrame([("a", "c", "antonym")], "from_lex string, to_lex string, rel string"),
    )
    c = net.coded(net_)
    k = {r["form"]: r["k"] for r in c.names.collect()}
    assert [k[w] for w in ("fein", "gut", "mies")] == [0, 1, 2]
    graph = net.coded_graph(c)
    assert sorted(map(tuple, graph.collect())) == [(0, 1, 1), (1, 0, 1), (2, 0, 1), (2, 1, 1)]
    assert sorted(map(tuple, net.coded_matrix(c).where("i <> j").collect())) == [(0, 1, 0.2), (0, 2, 0.2), (1, 0, 0.2), (1, 2, 0.2), (2, 1, -0.2)]
    graph.explain()
    assert not any("form" in line or "pos" in line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line and "key" in line)


def test_tallies_in_bits_are_the_plain_ones(spark):
    words = ["the", "thing", "erble", "Weiß", "x", "thing"]
    texts = docs(spark, " ".join(words * 25) + ". the thing. x", "erble the", None)
    toks = corpus.tokens(texts)
    lexicon = spark.createDataFrame([("the thing", "positive"), ("erble", "negative"), ("weiss", "positive"), ("thing", "negative")], "term string, polarity string")
    hits = evaluate.match(toks, lexicon)
    gold = spark.createDataFrame([(0, 0, k, k, c) for k, c in ((1, "negative"), (2, "positive"), (64, "negative"), (130, "positive"), (900, "positive"))] + [(2, 7, 0, 0, "positive")], "doc_id long, sent_id int, start int, end int, class string")
    plain, bits = (sorted(map(tuple, evaluate.tally(toks, hits, gold, once).collect())) for once in (False, True))
    assert plain == bits and sum(r[2] + r[3] for r in bits if r[1] == "neutral") + sum(r[4] for r in bits if r[1] == "neutral") >= toks.count() - gold.count()
    # tokens are shuffled as a row for each 64 of a sentence, and only words of entries to be matched
    evaluate.tally(toks, hits, gold, True).collect()
    assert max(n for name, n in made(hits) if "Aggregate" in name or "Join" in name) < 2 * hits.count() + 200
    sized = evaluate.tally_sizes(toks, hits.withColumn("rank", F.col("start") % 3), gold, [0, 1, 2], True)
    for size in (0, 1, 2):
        want = evaluate.tally(toks, hits.where(F.col("start") % 3 <= size), gold)
        assert sorted(map(tuple, sized.where(F.col("size") == size).drop("size").collect())) == sorted(map(tuple, want.collect()))
