"""Lexical nets and signed term graphs.

A net is four tables: ``synset(synid, pos)``, ``lex_unit(lexid, synid)``,
``lex_form(lexid, form)``, ``con_rel(from_syn, to_syn, rel)`` and
``lex_rel(from_lex, to_lex, rel)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, numbered

ANTONYM = ("has_antonym", "antonym")
SYNONYM = ("has_participle", "has_pertainym", "has_hyponym", "entails", "is_entailed_by")


@dataclass
class Net:
    synset: DataFrame
    lex_unit: DataFrame
    lex_form: DataFrame
    con_rel: DataFrame
    lex_rel: DataFrame

    def members(self) -> DataFrame:
        """(synid, pos, lexid, form)."""
        return self.synset.join(self.lex_unit, "synid").join(self.lex_form, "lexid").select("synid", "pos", "lexid", "form")

    def terms(self) -> DataFrame:
        return self.members().select("form", "pos").distinct()


def add_inverse(rel: DataFrame, a: str, b: str) -> DataFrame:
    """Relations with their declared inverses as rows of their own."""
    return rel.select(a, b, "rel").union(rel.where("inv IS NOT NULL").select(F.col(b), F.col(a), F.col("inv"))).distinct()


def seed_nodes(net: Net, seeds: DataFrame, pos: list[str] | None = None) -> DataFrame:
    """(form, pos, polarity) of the seeds that the net has."""
    out = net.terms().join(seeds.withColumnRenamed("term", "form"), "form")
    return out.where(F.col("pos").isin(*pos)) if pos else out


def seed_synsets(net: Net, seeds: DataFrame) -> DataFrame:
    return net.members().join(seeds.withColumnRenamed("term", "form"), "form").select("synid", "polarity").distinct()


def cross_pos(seeds: DataFrame, pos: list[str]) -> DataFrame:
    """Every seed with each part of speech."""
    return seeds.select("term", F.explode(F.array(*map(F.lit, pos))).alias("pos"), "polarity")


@dataclass
class Coded:
    """A net whose terms are numbers, in the order of form and part of speech."""

    net: Net
    names: DataFrame
    members: DataFrame

    def name(self) -> DataFrame:
        """(form, pos, k)."""
        return broadcast_if_small(self.names)

    def numbers(self, rows: DataFrame) -> DataFrame:
        """``rows(form, pos, ...)`` with k for the term; others go."""
        return rows.join(self.name(), ["form", "pos"]).drop("form", "pos")

    def named(self, rows: DataFrame, **columns: str) -> DataFrame:
        """``rows`` with two columns for each of ``columns``: number to the names of form and part of speech."""
        for number, form in columns.items():
            pos = "pos" if form == "form" else f"{form}_pos"
            rows = rows.join(self.name().selectExpr(f"form AS {form}", f"pos AS {pos}", f"k AS {number}"), number).drop(number)
        return rows

    def lists(self) -> DataFrame:
        """(synid, ks): a row for each synset."""
        return self.members.groupBy("synid").agg(F.collect_list("k").alias("ks"))


def coded(net: Net) -> Coded:
    names = materialize(numbered(net.terms().orderBy("form", "pos"), "k").select("form", "pos", F.col("k").cast("int").alias("k")))
    out = Coded(net, names, net.synset)
    out.members = materialize(out.numbers(net.members().select("form", "pos", "synid", "lexid")))
    return out


def _pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(key): every number of ``first`` with every other of ``second``, both in one long."""
    one = rows.select(F.explode(first).alias("i"), second).select("i", F.explode(second).alias("j")).where("i <> j")
    return one.select(_key("i", "j"))


def _key(i: str, j: str) -> Column:
    return F.shiftleft(F.col(i).cast("long"), 32).bitwiseOR(F.col(j).cast("long")).alias("key")


def _ends() -> list[Column]:
    return [F.shiftright("key", 32).cast("int").alias("i"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("j")]


def _related(c: Coded, kinds: tuple[str, ...], lists: DataFrame) -> DataFrame:
    """(rel, ks, other): the terms of both ends of conceptual relations."""
    rel = c.net.con_rel.where(F.col("rel").isin(*kinds))
    return rel.join(lists.selectExpr("synid AS from_syn", "ks"), "from_syn").join(lists.selectExpr("synid AS to_syn", "ks AS other"), "to_syn").select("rel", "ks", "other")


def coded_graph(c: Coded, ext_rel: bool = True) -> DataFrame:
    """(i, j, w) of ``term_graph``."""
    lists = c.lists()
    edges = _pairs(lists.select("ks", F.col("ks").alias("other")), "ks", "other")
    if ext_rel:
        # targets of lexical relations stand for their forms, with the least of their parts of speech
        target = c.members.join(c.name(), "k").groupBy(F.col("lexid").alias("to_lex"), "form").agg(F.min_by("k", "pos").alias("j"))
        lex = c.net.lex_rel.where(F.col("rel").isin(*SYNONYM)).join(c.members.selectExpr("lexid AS from_lex", "k AS i"), "from_lex").join(target, "to_lex").where("i <> j")
        edges = edges.unionByName(_pairs(_related(c, SYNONYM, lists), "ks", "other")).unionByName(lex.select(_key("i", "j")))
    return edges.groupBy("key").agg(F.count("*").alias("w")).select(*_ends(), "w")


def term_graph(net: Net, ext_rel: bool = True) -> DataFrame:
    """(src, src_pos, dst, dst_pos, w): how many synsets, and relations, tie two terms."""
    c = coded(net)
    return c.named(coded_graph(c, ext_rel), i="src", j="dst").select("src", "src_pos", "dst", "dst_pos", "w")


def transition(graph: DataFrame, teleport: float = 0.0, source: tuple[str, ...] = ("src", "src_pos"), order: tuple[str, ...] = ("dst", "dst_pos")) -> DataFrame:
    """The graph with p, each source's share less the teleport mass, and the running sum of p."""
    by = Window.partitionBy(*source)
    p = graph.withColumn("p", F.col("w") / F.sum("w").over(by) * (1 - teleport))
    return p.withColumn("cum_p", F.sum("p").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def net_transition(net: Net) -> DataFrame:
    """``transition`` of the net's term graph; the numbers have the order of the names."""
    c = coded(net)
    out = transition(coded_graph(c), source=("i",), order=("j",))
    return c.named(out, i="src", j="dst").select("src", "src_pos", "dst", "dst_pos", "w", "p", "cum_p")


def mean_degree(graph: DataFrame) -> DataFrame:
    return graph.groupBy("src", "src_pos").agg(F.count("*").alias("d")).agg(F.avg("d").alias("mean_degree"))


def coded_matrix(c: Coded) -> DataFrame:
    """(i, j, w) of ``signed_matrix``."""
    lists = c.lists()
    anti = F.col("rel").isin(*ANTONYM)
    # the least counts: con relations, synset mates, lexical relations; of one kind the smallest weight
    con = _related(c, (*ANTONYM, *SYNONYM), lists).withColumn("rank", F.when(anti, 0).otherwise(1))
    # written at [target, source]
    far = con.select("rank", F.explode("other").alias("i"), "ks").select("rank", "i", F.explode("ks").alias("j")).where("i <> j").select(_key("i", "j"), "rank")
    mates = _pairs(lists.select("ks", F.col("ks").alias("other")), "ks", "other").withColumn("rank", F.lit(2))
    lex = c.net.lex_rel.where(F.col("rel").isin(*ANTONYM, *SYNONYM)).join(c.members.selectExpr("lexid AS to_lex", "k AS i"), "to_lex").join(c.members.selectExpr("lexid AS from_lex", "k AS j"), "from_lex").where("i <> j").select(_key("i", "j"), F.when(anti, 3).otherwise(4).alias("rank"))
    best = mates.unionByName(far).unionByName(lex).groupBy("key").agg(F.min("rank").alias("rank"))
    cells = best.select(*_ends(), F.when(F.col("rank").isin(0, 3), -0.2).otherwise(0.2).alias("w"))
    return cells.unionByName(c.names.select(F.col("k").alias("i"), F.col("k").alias("j"), F.lit(1.2).alias("w")))


def signed_matrix(net: Net) -> DataFrame:
    """Cells (i, i_pos, j, j_pos, w): 1.2 on the diagonal, 0.2 for synset mates and related terms, -0.2 for antonyms.

    Of conflicting cells the con relation wins, then the synset, then the lexical
    relation; of one rank the smallest weight.
    """
    c = coded(net)
    out = c.named(coded_matrix(c).withColumnsRenamed({"i": "_i", "j": "_j"}), _i="i", _j="j")
    return out.select("i", "i_pos", "j", "j_pos", "w")


def prune_normalize(cells: DataFrame) -> DataFrame:
    """Negative cells of ``cells(i, j, w)`` dropped, columns to sum 1."""
    some = cells.where("w > 0")
    return some.join(broadcast_if_small(some.groupBy("j").agg(F.sum("w").alias("_s"))), "j").select("i", "j", (F.col("w") / F.col("_s")).alias("w"))


def reachable(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, depth): breadth-first distances over ``edges(src, dst)`` from ``start(node)``; all rounds if None."""
    edges = materialize(edges.select("src", "dst"))
    known = front = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while (rounds is None or depth < rounds) and not front.isEmpty():
        depth += 1
        step = edges.join(broadcast_if_small(front), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(depth).alias("depth"))
        # rewritten whole, so that the plan stays the same size in every round
        known = materialize(known.unionByName(step).groupBy("node").agg(F.min("depth").alias("depth")))
        front = known.where(F.col("depth") == depth)
    return known


def seed_values(*sets: tuple[DataFrame, float]) -> DataFrame:
    """(form, pos, x) of several ``(nodes(form, pos), value)``: of a node in more than one the last counts."""
    out = None
    for k, (nodes, value) in enumerate(sets):
        one = nodes.select("form", "pos", F.lit(float(value)).alias("x"), F.lit(k).alias("k"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("form", "pos").agg(F.max_by("x", "k").alias("x"))


def drawing(net: Net) -> tuple[DataFrame, DataFrame]:
    """(nodes(form, pos, x, y), edges(src, dst, kind)) for a picture: places by hash, kinds ``synonym``, ``antonym`` and ``other``."""
    place = lambda k: F.pmod(F.xxhash64("form", "pos", F.lit(k)), F.lit(1_000_000)) / 1_000_000
    nodes = net.terms().select("form", "pos", place(0).alias("x"), place(1).alias("y"))
    kind = F.when(F.col("rel").isin(*SYNONYM), "synonym").when(F.col("rel").isin(*ANTONYM), "antonym").otherwise("other")
    m = net.members().select("synid", "form").distinct()
    con = net.con_rel.join(m.selectExpr("synid AS from_syn", "form AS src"), "from_syn").join(m.selectExpr("synid AS to_syn", "form AS dst"), "to_syn").select("src", "dst", kind.alias("kind"))
    lex = net.lex_rel.join(net.lex_form.selectExpr("lexid AS from_lex", "form AS src"), "from_lex").join(net.lex_form.selectExpr("lexid AS to_lex", "form AS dst"), "to_lex").select("src", "dst", kind.alias("kind"))
    mates = m.join(m.withColumnRenamed("form", "dst"), "synid").where("form < dst").select(F.col("form").alias("src"), "dst", F.lit("synonym").alias("kind"))
    return nodes, con.unionByName(lex).unionByName(mates).distinct()
