"""How the operators' inputs are made from the tables: stand-ins for a tagged corpus, a lexical net, embeddings, gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..operators.net import Net

#: Frequent words of the invented prose.
WORDS = {"positive": ("thble", "thtion", "thing", "attion"), "negative": ("erble", "ertion", "ering", "oning"), "neutral": ("ontion", "antion", "retion")}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tokens(read(spark, sf, "documents").select("doc_id", "text"))


def word_seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, k) for k, ws in WORDS.items() for w in ws], "term string, polarity string")


def net(spark: SparkSession, sf: str) -> Net:
    """Orders are synsets, parts in them lexical units, a customer's next order a hyponym, an order's least and greatest part antonyms."""
    part = read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("form"))
    unit = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    lexid = lambda key: F.concat_ws("-", F.col("l_orderkey").cast("string"), key.cast("string"))
    units = unit.select(lexid(F.col("l_partkey")).alias("lexid"), F.col("l_orderkey").alias("synid"), "form")
    pos = F.when(F.col("synid") % 3 == 0, "adj").when(F.col("synid") % 3 == 1, "nomen").otherwise("verben")
    ends = unit.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a < b")
    next_order = F.lead("o_orderkey").over(corpus.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    con = read(spark, sf, "orders").select(F.col("o_orderkey").alias("from_syn"), next_order.alias("to_syn"), F.lit("has_hyponym").alias("rel")).where("to_syn IS NOT NULL")
    return Net(
        units.select("synid").distinct().withColumn("pos", pos),
        units.select("lexid", "synid"),
        units.select("lexid", "form"),
        con,
        ends.select(lexid(F.col("a")).alias("from_lex"), lexid(F.col("b")).alias("to_lex"), F.lit("antonym").alias("rel")),
    )


def net_seeds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.when(F.col("p_partkey") % 97 == 0, 0).when(F.col("p_partkey") % 101 == 1, 1).when(F.col("p_partkey") % 103 == 2, 2)
    forms = read(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("term"), k.alias("k")).where("k IS NOT NULL").groupBy("term").agg(F.min("k").alias("k"))
    return forms.select("term", F.when(F.col("k") == 0, "positive").when(F.col("k") == 1, "negative").otherwise("neutral").alias("polarity"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def vector_class(label) -> F.Column:
    return F.when(label <= 3, "positive").when(label <= 6, "negative").otherwise("neutral")


def vector_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), vector_class(F.col("label")).alias("polarity"))


def lexicon(spark: SparkSession) -> DataFrame:
    """Seeds, and two entries of two words."""
    return word_seeds(spark).where("polarity <> 'neutral'").union(spark.createDataFrame([("the thing", "positive"), ("of ering", "negative")], "term string, polarity string"))


def gold(toks: DataFrame, labels: DataFrame) -> DataFrame:
    """Polar seed words in labelled documents, with the document's class."""
    kind = F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "negative")
    words = [w for k in ("positive", "negative") for w in WORDS[k]]
    marked = labels.select("doc_id", kind.alias("class")).where("class IS NOT NULL")
    return toks.where(F.col("lemma").isin(*words)).join(marked, "doc_id").select("doc_id", "sent_id", F.col("pos").alias("start"), F.col("pos").alias("end"), "class")


def annotations(toks: DataFrame, which: int) -> DataFrame:
    """Two annotators' spans: each seed word with its follower, at positions that annotator does not skip."""
    kind = F.when(F.col("lemma").isin(*WORDS["positive"]), "positive").when(F.col("lemma").isin(*WORDS["negative"]), "negative")
    skip = F.col("pos") % (7 if which == 1 else 5) == 0
    wide = (F.col("pos") + which) % 2
    at = F.col("sent_id") * 100000 + F.col("pos")
    return toks.withColumn("class", kind).where(F.col("class").isNotNull() & ~skip).select("doc_id", "class", F.sequence(at, at + wide).alias("ids"))
