"""Tagged tokens, counts, context windows and co-occurrence."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import broadcast_if_small, materialize, numbered

MIN_COUNT, CONTEXT, TOP = 4, 5, 25
#: Words that are counted at once, in bytes.
COUNT_BYTES = 8 << 20
#: Negators of glosses.
NEGATORS = ("nicht", "keine", "kein", "keines", "keinem", "keinen")


def tag_of(form: Column) -> Column:
    """A stand-in tagger: capitals are nouns, final n verbs, other long words adjectives, the rest conjunctions."""
    return F.when(F.substring(form, 1, 1) != F.lower(F.substring(form, 1, 1)), "NN").when(form.endswith("n"), "VV").when(F.length(form) > 4, "ADJD").otherwise("KON")


def lemma_of(form: Column) -> Column:
    """``normalize`` of a run of letters, which has no blanks."""
    return F.replace(F.lower(form), F.lit("ß"), F.lit("ss"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, form, lemma, tag): letter runs of sentences that end at full stops and newlines."""
    sents = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.\n]")).alias("sent_id", "s"))
    forms = sents.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("s", F.lit(r"(\p{L}+)"), F.lit(1))).alias("pos", "form"))
    return forms.select("doc_id", "sent_id", "pos", "form", lemma_of(F.col("form")).alias("lemma"), tag_of(F.col("form")).alias("tag"))


def kept(toks: DataFrame) -> DataFrame:
    """Informative tokens whose lemma is a plain word."""
    return toks.where(T.informative(F.col("tag")) & T.check_word(F.col("lemma")))


def once(docs: DataFrame) -> bool:
    """Whether no two rows have one ``doc_id``."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def kept_words(text: Column) -> Column:
    """Of each sentence the lemmas of ``kept(tokens)`` in order, within the row."""
    words = lambda s: F.transform(F.filter(F.regexp_extract_all(s, F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: T.informative(tag_of(w)) & T.check_word(lemma_of(w))), lemma_of)
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]"), words)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, sents) of ``docs(doc_id, text)``: a document's kept lemmas by sentence; no shuffle unless an id is there twice."""
    return docs.select("doc_id", kept_words(F.col("text")).alias("sents")) if once(docs) else gathered(kept(tokens(docs)))


def gathered(toks: DataFrame) -> DataFrame:
    """(doc_id, sents) of any tokens."""
    inner = lambda *k: F.array_sort(F.collect_list(F.struct(*k)))
    sents = toks.groupBy("doc_id", "sent_id").agg(F.transform(inner("pos", "lemma"), lambda e: e["lemma"]).alias("words"))
    return sents.groupBy("doc_id").agg(F.transform(inner("sent_id", "words"), lambda e: e["words"]).alias("sents"))


def lemmatize(toks: DataFrame, form2lemma: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Left join with the identity as default; forms in ``stop`` lose their lemma.  A dictionary's first entry counts."""
    one = form2lemma.groupBy("form").agg(F.min("lemma").alias("_l"))
    out = toks.drop("lemma").join(one, "form", "left").withColumn("lemma", F.coalesce("_l", T.normalize(F.col("form")))).drop("_l")
    if stop is not None:
        out = out.join(stop.select("form").distinct().withColumn("_s", F.lit(True)), "form", "left").withColumn("lemma", F.when(F.col("_s").isNull(), F.col("lemma"))).drop("_s")
    return out


def seed_match(patterns: dict[str, list[str]] | None, name: str) -> Column:
    """Whether a seed expression of any class matches the column."""
    every = [p for ps in (patterns or {}).values() for p in ps]
    return F.coalesce(F.col(name).rlike(T.either(every)), F.lit(False)) if every else F.lit(False)


def message_classes(words: DataFrame, seeds: DataFrame, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, class) of messages ``words(doc_id, term)``, distinct: the first of positive, negative and neutral that has a seed in it.

    Expressions are searched in a message's sorted words, joined by blanks.
    """
    rank = F.min(F.when(F.col("polarity") == "positive", 0).when(F.col("polarity") == "negative", 1).when(F.col("polarity") == "neutral", 2))
    found = words.join(seeds, "term").groupBy("doc_id").agg(rank.alias("c")).where("c IS NOT NULL")
    if any((patterns or {}).values()):
        text = words.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("text"))
        hit = F.when(seed_match({"p": patterns.get("positive", [])}, "text"), 0).when(seed_match({"n": patterns.get("negative", [])}, "text"), 1)
        found = found.unionByName(text.select("doc_id", hit.alias("c")).where("c IS NOT NULL")).groupBy("doc_id").agg(F.min("c").alias("c"))
    return found.select("doc_id", F.when(F.col("c") == 0, "positive").when(F.col("c") == 1, "negative").otherwise("neutral").alias("class"))


def sessionise(lines: DataFrame, boundary: Column, by: str, order: str) -> DataFrame:
    """Units cut at boundary rows: a running count per file."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("unit", F.sum(F.when(boundary, 1).otherwise(0)).over(w))


def word_counts(toks: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    return toks.groupBy("lemma").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("df")).where(F.col("n") >= least)


def bigrams(toks: DataFrame) -> DataFrame:
    return text_pairs(gathered(toks), 1).select(F.col("a").alias("prev"), F.col("b").alias("lemma"), "n")


def feature_df(toks: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Messages that hold each unigram or adjacent bigram."""
    return text_feature_df(gathered(toks), least)


def text_feature_df(rows: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """``feature_df`` of ``texts``: a document's features are made distinct where it is read, only counts are shuffled."""

    def count(sents: pa.Array) -> pa.Table:
        doc, (sent, x, words) = np.repeat(np.arange(len(sents)), _lengths(sents)), _coded(sents.flatten())
        doc, v = doc[sent], len(words)
        two = sent[:-1] == sent[1:]
        # one word: its code; two: after the codes, by both
        key = np.concatenate([x, v + x[:-1][two] * v + x[1:][two]])
        both = np.unique(np.column_stack([np.concatenate([doc, doc[:-1][two]]), key]).view("i8,i8"))["f1"]
        key, n = np.unique(both, return_counts=True)
        at = int(np.searchsorted(key, v))
        first, second = np.divmod(key[at:] - v, max(v, 1))
        pairs = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
        return pa.table({"feature": pa.concat_arrays([words.take(pa.array(key[:at])), pairs]), "n": n})

    found = rows.select("sents").mapInArrow(_counting(count), "feature string, n long")
    return found.groupBy("feature").agg(F.sum("n").alias("df")).where(F.col("df") >= least)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(sents: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of the sentence, code of the word, words) of an Arrow column of word lists."""
    codes = sents.flatten().dictionary_encode()
    return np.repeat(np.arange(len(sents)), _lengths(sents)), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary


def _counting(count):
    """A pass that counts ``COUNT_BYTES`` or so of the first column at once, and hands on the counts in small batches."""

    def run(batches):
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch.column(0))
                size += batch.column(0).nbytes
            if held and (batch is None or size >= COUNT_BYTES):
                yield from count(pa.chunked_array(held).combine_chunks()).to_batches(max_chunksize=1 << 16)
                held, size = [], 0

    return run


def context_pairs(toks: DataFrame, k: int = CONTEXT) -> DataFrame:
    """(a, b, n): how often a stands among the k kept tokens before b in a sentence."""
    return text_pairs(gathered(toks), k)


def text_pairs(rows: DataFrame, k: int = CONTEXT) -> DataFrame:
    """``context_pairs`` of ``texts``: counted where they are read, then summed."""

    def count(sents: pa.Array) -> pa.Table:
        sent, x, words = _coded(sents)
        v = max(1, len(words))
        key = np.concatenate([(x[:-d] * v + x[d:])[sent[:-d] == sent[d:]] for d in range(1, k + 1)])
        key, n = np.unique(key, return_counts=True)
        a, b = np.divmod(key, v)
        return pa.table({"a": words.take(pa.array(a)), "b": words.take(pa.array(b)), "n": n})

    sents = rows.select(F.explode("sents").alias("ws"))
    return sents.mapInArrow(_counting(count), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def cooccurrence(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The symmetric matrix over frequent words (a self pair counts twice), pairs of the least count kept."""
    w = words.select("lemma")
    some = pairs.where(F.col("n") >= MIN_COUNT).join(w.withColumnRenamed("lemma", "a"), "a", "left_semi").join(w.withColumnRenamed("lemma", "b"), "b", "left_semi")
    return some.select("a", "b", "n").union(some.select(F.col("b"), F.col("a"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def prune(cooc: DataFrame, top: int = TOP) -> DataFrame:
    """Of each row of the symmetric matrix, the stored neighbours among the ``top`` largest dot products of rows, ties kept; weights log1p.

    Only dot products of stored cells are wanted, so their terms are the matrix's
    triangles.  Words are numbered by their neighbours, fewest first, and every
    triangle is met once, from its least word: however often a word stands beside
    others, it has few greater neighbours.
    """
    size = cooc.groupBy("a").agg(F.count("*").alias("d"))
    names = materialize(numbered(size.orderBy("d", "a").select("a"), "i"))
    name = broadcast_if_small(names)
    coded = cooc.join(name, "a").join(name.selectExpr("a AS b", "i AS j"), "b").select(F.col("i").cast("int"), F.col("j").cast("int"), "n")
    cells = materialize(coded.where("i <= j"))
    up = cells.where("i < j")
    wedge = up.selectExpr("i", "j", "n AS x").join(up.selectExpr("i", "j AS k", "n AS y"), "i").where("j < k")
    part = lambda i, j, x: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), x.alias("dot"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    three = wedge.join(up.selectExpr("i AS j", "j AS k", "n AS z"), ["j", "k"]).select(F.inline(F.array(part("i", "j", y * z), part("i", "k", x * z), part("j", "k", x * y))))
    # a word that stands beside itself is a neighbour of both
    loops = broadcast_if_small(cells.where("i = j").selectExpr("i AS k", "n AS y"))
    ends = up.select("i", "j", "n", F.explode(F.array("i", "j")).alias("k")).join(loops, "k").select("i", "j", (F.col("n") * F.col("y")).alias("dot"))
    square = F.col("n") * F.col("n")
    own = up.select(F.explode(F.array("i", "j")).alias("i"), square.alias("dot")).unionByName(cells.where("i = j").select("i", square.alias("dot"))).groupBy("i").agg(F.sum("dot").alias("dot"))
    terms = three.unionByName(ends).unionByName(own.join(cells.where("i = j").select("i"), "i", "left_semi").select("i", F.col("i").alias("j"), "dot"))
    dots = terms.withColumn("w", F.lit(None).cast("long")).unionByName(cells.select("i", "j", F.lit(None).cast("long").alias("dot"), F.col("n").alias("w"))).groupBy("i", "j").agg(F.sum("dot").alias("dot"), F.max("w").alias("w")).where("dot IS NOT NULL")
    both = dots.select("w", "dot", F.inline(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))))
    rank = F.rank().over(Window.partitionBy("i").orderBy(F.desc("dot")))
    best = both.withColumn("r", rank).where(F.col("r") <= top)
    out = best.join(name.selectExpr("a AS _i", "i"), "i").join(name.selectExpr("a AS _j", "i AS j"), "j")
    return out.select(F.col("_i").alias("i"), F.col("_j").alias("j"), F.log1p("w").alias("w"))


def negation_scope(toks: DataFrame, negators: tuple[str, ...] = NEGATORS) -> DataFrame:
    """Weight -1 for every token after a negator of its sentence, else 1."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.max(F.col("lemma").isin(*negators).cast("int")).over(w)
    return toks.withColumn("weight", F.when(hit == 1, -1).otherwise(1))


def label_lines(docs: DataFrame, positive: list[str], negative: list[str], neutral: list[str], patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """1, 2 or 0 for the first class one of whose terms stands in the line, or whose expression matches it, else ``_``."""
    words = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\p{L}+)"), F.lit(1)), T.normalize)
    has = lambda terms: F.arrays_overlap(words, F.array(*map(F.lit, terms)))
    line = docs.withColumn("_line", T.normalize(F.coalesce("text", F.lit(""))))
    of = lambda k: seed_match({k: (patterns or {}).get(k, [])}, "_line")
    return line.select("doc_id", F.when(has(positive) | of("positive"), "1").when(has(negative) | of("negative"), "2").when(has(neutral), "0").otherwise("_").alias("label"))


def tfidf(toks: DataFrame) -> DataFrame:
    """(doc_id, lemma, w): 1 + ln tf, smoothed idf plus one, unit length."""
    tf = toks.groupBy("doc_id", "lemma").agg(F.count("*").alias("tf"))
    df = tf.groupBy("lemma").agg(F.count("*").alias("df"))
    n = tf.select("doc_id").distinct().agg(F.count("*").alias("docs"))  # one row
    raw = tf.join(df, "lemma").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "lemma", (F.col("w") / F.col("norm")).alias("w"))


def rocchio(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class, p) of every document by its distance to the centroids of ``classes(doc_id, class)``: total less distance, normalised."""
    size = classes.groupBy("class").agg(F.count("*").alias("n"))
    centroid = weights.join(classes, "doc_id").groupBy("class", "lemma").agg(F.sum("w").alias("s")).join(F.broadcast(size), "class").select("class", "lemma", (F.col("s") / F.col("n")).alias("c"))
    norm = centroid.groupBy("class").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    dots = weights.join(centroid, "lemma").groupBy("doc_id", "class").agg(F.sum(F.col("w") * F.col("c")).alias("wc"))
    # a row per document and class: classes are three
    grid = weights.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("ww")).crossJoin(F.broadcast(norm))
    dist = grid.join(dots, ["doc_id", "class"], "left").withColumn("d", F.sqrt(F.greatest(F.col("ww") + F.col("cc") - 2 * F.coalesce("wc", F.lit(0.0)), F.lit(0.0))))
    by = Window.partitionBy("doc_id")
    rest = dist.withColumn("r", F.sum("d").over(by) - F.col("d"))
    return rest.select("doc_id", "class", (F.col("r") / F.sum("r").over(by)).alias("p"))
