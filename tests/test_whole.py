"""Queries do the whole job: cases beyond the rounds, lengths and samples that they once stopped at."""

import inspect

import numpy as np
import pytest

from lexigrow.operators import corpus, embed, evaluate, methods
from lexigrow.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_reachability_all_goes_past_six_steps(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in range(1, 13)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(5).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["node"]: r["depth"] for r in catalogue.queries()["reachability_all"](spark, str(tmp_path)).collect()}
    assert got == {k: k - 1 for k in range(1, 13)}


def test_long_turns_are_aligned_whole(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(10_050))
    spark.createDataFrame([(1, 0, text), (1, 1, text)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalogue.queries()["align_sequences"](spark, str(tmp_path)).collect()
    assert [(r["turn"], r["n_aligned"]) for r in rows] == [(0, 10_050)]


def test_alignment_in_blocks_is_the_same():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 3, rng.integers(0, 15)).tolist() for _ in range(2))
        assert evaluate.align(a, b, held=1) == evaluate.align(a, b, held=20) == evaluate.align(a, b)


@pytest.mark.parametrize(
    "name, home, method, cuts",
    [
        ("lexicon_bfs", methods, "breadth_first", {"rounds": None}),
        ("lexicon_best_path", methods, "path_lexicon", {"rounds": 20}),
        ("lexicon_ising", methods, "spins", {"sweeps": 10}),
        ("lexicon_label_prop_full", methods, "label_propagation", {"rounds": 300, "tolerance": True}),
        ("lexicon_random_walk_full", methods, "random_walk", {"steps": 17, "threshold": 0.5}),
        ("lexicon_nearest_centroid_full", embed, "nearest_centroid", {"rounds": None}),
    ],
)
def test_iterative_queries_run_in_full(spark, monkeypatch, name, home, method, cuts):
    class Called(Exception):
        pass

    shape = inspect.signature(getattr(home, method))

    def spy(*args, **named):
        bound = shape.bind(*args, **named)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in cuts})

    monkeypatch.setattr(home, method, spy)
    monkeypatch.setattr(catalogue, "_cooc", lambda s, d: spark.createDataFrame([], "a string, b string, n long"))
    monkeypatch.setattr(corpus, "prune", lambda df, *a: df)
    with pytest.raises(Called) as got:
        catalogue.queries()[name](spark, SF)
    assert got.value.args[0] == cuts
