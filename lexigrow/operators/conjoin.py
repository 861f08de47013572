"""Conjoined words of dependency trees, and annotation carried from one tokenisation to another."""

from __future__ import annotations

import re
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import align

#: Conjunctions that set both sides apart, and those that join them; relations of conjuncts.
ADVERSATIVE = ("aber",)
COORDINATING = ("und", "oder", ",")
RELATIONS = ("CD", "CJ")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]+$")


def _normal(s: str | None) -> str:
    return re.sub(r"(?:\t| \s)+", " ", (s or "").lower()).replace("ß", "ss").strip()


def chains(words: list[tuple[str, str, str, str]]) -> list[list]:
    """Conjoined phrases of a tree of (idx, lemma, head, relation): nested lists, a phrase's first word before its conjuncts."""
    below: dict[str, list] = {}
    for w in words:
        below.setdefault(w[2], []).append(w)
    out: list[list] = []
    for root in below.get("0", []):
        found: list[list] = []
        # (word, whether a conjunct, its phrase, the phrase that it goes to); deep trees don't recurse
        stack: list[tuple] = [(root, False, None, False)]
        made: dict[str, list] = {}
        while stack:
            word, conjunct, parent, done = stack.pop()
            if not done:
                if word[0] in made:
                    continue  # a loop in a broken tree
                made[word[0]] = [_normal(word[1])]
                stack.append((word, conjunct, parent, True))
                for child in reversed(below.get(word[0], [])):
                    stack.append((child, child[3] in RELATIONS, word[0], False))
                continue
            phrase = made[word[0]]
            if conjunct:
                made[parent].append(phrase if len(phrase) > 1 else phrase[0])
            elif len(phrase) > 1:
                found.append(phrase)
        out += found
    return out


def sides(phrase: list | str) -> tuple[set, set]:
    """(words joined with the phrase's first, words set against it)."""
    if isinstance(phrase, str):
        return {phrase}, set()
    same, against = set(), set()
    for part in phrase[1:]:
        s, a = sides(part)
        same |= s
        against |= a
    if phrase[0] in ADVERSATIVE:
        # what follows belongs to the other side
        return against, same
    if phrase[0] not in COORDINATING:
        same.add(phrase[0])
    return same, against


def conjoined_pairs(words: DataFrame) -> DataFrame:
    """(a, b, w) of ``conll`` rows, broken sentences left out before: 1 for words of one side, -1 across.

    A task gets one sentence at a time.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order")
        rows = []
        for phrase in chains(list(zip(group["idx"], group["plemma"], group["phead"], group["pdeprel"]))):
            same, against = (sorted(w for w in side if w and not PUNCTUATION.match(w)) for side in sides(phrase))
            rows += [(a, b, 1) for a, b in (*combinations(same, 2), *combinations(against, 2))]
            rows += [(a, b, -1) for a, b in product(same, against)]
        return pd.DataFrame(rows, columns=["a", "b", "w"])

    held = words.select(F.xxhash64("file", "sent_id").alias("s"), "file", "sent_id", F.col("idx").cast("int").alias("order"), "idx", "plemma", "phead", "pdeprel")
    return held.groupBy("file", "sent_id").applyInPandas(lambda g: run(g), "a string, b string, w int")


def same_word(a: str, b: str) -> bool:
    """Alike but for case and a leading hash."""
    return a.lower().lstrip("#") == b.lower().lstrip("#")


def mangle(name: str) -> str:
    """An attribute's name: its parts capitalised, punctuation deleted."""
    return re.sub(r"[!-/:-@\[-`{-~]", "", name.title())


def markable_features(markables: DataFrame, reference: tuple[str, ...] = ("sentiment_ref", "ref")) -> DataFrame:
    """(doc, wid, feats): ``Level|id|Name`` attributes at a span's first word, a reference to the markable alone at the others."""

    @F.pandas_udf("map<string,string>")
    def named(level: pd.Series, mid: pd.Series, attrs: pd.Series) -> pd.Series:
        out = []
        for kind, own, given in zip(level, mid, attrs):
            given = dict(given or {})
            refs = [given.pop(r) for r in reference if r in given]
            held = next((r for r in refs if r and r != "empty"), None)
            own = held.split(":", 1)[-1] if held else own
            kind = mangle(kind)
            out.append({f"{kind}|{own}|{mangle(k)}": v for k, v in given.items()} | {f"{kind}|{own}|{kind}": "True"})
        return pd.Series(out)

    m = markables.select("doc", named("level", "mid", "attrs").alias("all"), F.posexplode("span").alias("i", "wid"))
    own = F.map_filter("all", lambda k, v: (v == "True") & (F.element_at(F.split(k, r"\|"), 1) == F.element_at(F.split(k, r"\|"), 3)))
    part = m.select("doc", "wid", F.explode(F.map_entries(F.when(F.col("i") == 0, F.col("all")).otherwise(own))).alias("e"))
    one = part.groupBy("doc", "wid", F.col("e.key").alias("key")).agg(F.min("e.value").alias("value"))
    return one.groupBy("doc", "wid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("feats"))


def positional(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, n, token, wid) of ``tokens(doc, n, token)`` and ``words(doc, wid, text)`` in order, end-of-line words skipped.

    A token that isn't its word, or that has none, stops the query.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("doc").orderBy("wid")) - 1
    held = words.where("text <> 'EOL' AND text <> 'eol'").withColumn("n", rank)
    both = tokens.join(held, ["doc", "n"], "left")
    right = F.lower(F.trim("token")) == F.lower(F.trim("text"))
    told = F.raise_error(F.concat(F.lit("token and word do not match: "), F.col("token"), F.lit(" "), F.coalesce("text", F.lit("(none)")))).cast("boolean")
    return both.where(F.when(F.coalesce(right, F.lit(False)), True).otherwise(told)).select("doc", "n", "token", "wid")


def merge_annotation(trees: DataFrame, words: DataFrame, features: DataFrame) -> DataFrame:
    """``trees(doc, place, form, feat, pfeat)`` with the features of the words that each form is aligned with.

    Both sides of a document are aligned in one task: a document here is a
    message, not a corpus.
    """
    feats = words.join(features, ["doc", "wid"], "left").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("wid", "text", "feats"))).alias("w"))
    rows = trees.select("doc", "place", "form").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "form"))).alias("t"))

    @F.pandas_udf("array<map<string,string>>")
    def added(forms: pd.Series, texts: pd.Series, maps: pd.Series) -> pd.Series:
        out = []
        for a, b, m in zip(forms, texts, maps):
            # the same key for words that are alike
            key = lambda x: (x or "").strip().lower().lstrip("#")
            held = [dict(x) if x is not None else {} for x in m]
            out.append([{k: v for j in js for k, v in held[j].items()} for js in align([key(x) for x in a], [key(x) for x in b])])
        return pd.Series(out)

    both = rows.join(feats, "doc").withColumn("added", added(F.col("t.form"), F.col("w.text"), F.col("w.feats")))
    new = both.select("doc", F.explode(F.arrays_zip(F.col("t.place").alias("place"), F.col("added").alias("added"))).alias("e")).select("doc", F.col("e.place").alias("place"), F.col("e.added").alias("added"))
    joined = trees.join(new, ["doc", "place"], "left")
    merged = lambda c: F.map_concat(F.map_filter(F.col(c), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("added", F.create_map().cast("map<string,string>"))), k)), F.coalesce("added", F.create_map().cast("map<string,string>")))
    return joined.withColumn("feat", merged("feat")).withColumn("pfeat", merged("pfeat")).drop("added")
