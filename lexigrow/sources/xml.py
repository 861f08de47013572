"""Lexical nets and annotations in XML, by Spark's own splittable reader; nets also in the line format of data files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.net import Net
from .lines import lines

SYNSET = "_id STRING, _category STRING, paraphrase STRING, lexUnit ARRAY<STRUCT<_id: STRING, orthForm: ARRAY<STRING>, orthVar: ARRAY<STRING>, example: ARRAY<STRUCT<text: STRING>>>>"
RELATION = "_from STRING, _to STRING, _name STRING, _inv STRING"


def _xml(spark: SparkSession, tag: str, schema: str, *paths: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(",".join(paths))


def synset_texts(spark: SparkSession, *paths: str, paraphrases: list[str] | None = None) -> DataFrame:
    """(synid, kind, txt): definitions (``def``) and examples (``example``); further definitions belong to all synsets of their lexical unit."""
    s = _xml(spark, "synset", SYNSET, *paths)
    own = s.where("paraphrase IS NOT NULL").select(F.col("_id").alias("synid"), F.lit("def").alias("kind"), F.col("paraphrase").alias("txt"))
    unit = s.select(F.col("_id").alias("synid"), F.explode("lexUnit").alias("u"))
    shown = unit.select("synid", F.explode("u.example.text").alias("txt")).where("txt IS NOT NULL").select("synid", F.lit("example").alias("kind"), "txt")
    out = own.unionByName(shown)
    if paraphrases:
        more = _xml(spark, "wiktionaryParaphrase", "_lexUnitId STRING, _wiktionarySense STRING", *paraphrases)
        owner = unit.select("synid", F.col("u._id").alias("_lexUnitId")).distinct()
        out = out.unionByName(more.where("_wiktionarySense IS NOT NULL").join(owner, "_lexUnitId").select("synid", F.lit("def").alias("kind"), F.col("_wiktionarySense").alias("txt")))
    return out


def relations(spark: SparkSession, tag: str, a: str, b: str, *paths: str) -> DataFrame:
    """(a, b, rel) of ``con_rel`` or ``lex_rel`` elements, with the inverses that they declare."""
    from ..operators.net import add_inverse

    rel = _xml(spark, tag, RELATION, *paths).select(F.col("_from").alias(a), F.col("_to").alias(b), F.col("_name").alias("rel"), F.when(F.col("_inv") != "", F.col("_inv")).alias("inv"))
    return add_inverse(rel, a, b)


def net_files(spark: SparkSession, synsets: list[str], relation_file: str) -> Net:
    """A lexical net from synset files and a relation file; no synset at all is an error."""
    s = _xml(spark, "synset", SYNSET, *synsets)
    unit = s.select(F.col("_id").alias("synid"), F.explode("lexUnit").alias("u"))
    if unit.isEmpty():
        raise ValueError(f"no synsets in {', '.join(synsets)}")
    forms = F.concat(F.coalesce("u.orthForm", F.array().cast("array<string>")), F.coalesce("u.orthVar", F.array().cast("array<string>")))
    return Net(
        s.select(F.col("_id").alias("synid"), F.col("_category").alias("pos")).distinct(),
        unit.select(F.col("u._id").alias("lexid"), "synid").distinct(),
        unit.select(F.col("u._id").alias("lexid"), F.explode(forms).alias("form")).where("form IS NOT NULL").select("lexid", T.normalize(F.col("form")).alias("form")).distinct(),
        relations(spark, "con_rel", "from_syn", "to_syn", relation_file),
        relations(spark, "lex_rel", "from_lex", "to_lex", relation_file),
    )


#: The names of the pointer symbols of the data files.
POINTERS = {
    "~": "Hyponym",
    "~i": "Instance Hyponym",
    "!": "Antonym",
    "#m": "Member holonym",
    "#p": "Part holonym",
    "#s": "Substance holonym",
    "$": "Verb Group",
    "%m": "Member meronym",
    "%p": "Part meronym",
    "%s": "Substance meronym",
    "&": "Similar to",
    "*": "Entailment",
    "+": "Derivationally related form",
    "-c": "Member of this domain - TOPIC",
    "-r": "Member of this domain - REGION",
    "-u": "Member of this domain - USAGE",
    ";c": "Domain of synset - TOPIC",
    ";r": "Domain of synset - REGION",
    ";u": "Domain of synset - USAGE",
    "<": "Participle of verb",
    "=": "Attribute",
    ">": "Cause",
    "@": "Hypernym",
    "@i": "Instance Hypernym",
    "\\": "Derived from adjective",
    "^": "Also see",
}


def data_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(synid, pos, lexemes, pointers, gloss): a row per line of data files; lines that begin with blanks and a digit are the licence.

    The count of words is hexadecimal, each word is followed by a number, each
    pointer has four fields, verbs have frames of three, and a bar begins the
    gloss.  A line without the bar where it must stand, or with an unknown
    pointer, stops the query.
    """
    rows = lines(spark, *paths).where(~F.col("line").rlike(r"^\s+[1-9]") & (F.trim("line") != "")).withColumn("t", F.split(F.trim("line"), r"\s+"))
    num = lambda at: F.get("t", at).try_cast("int")
    rows = rows.withColumn("words", F.conv(F.get("t", F.lit(3)), 16, 10).try_cast("int")).withColumn("p", F.lit(4) + 2 * F.col("words"))
    rows = rows.withColumn("pointers_n", num(F.col("p"))).withColumn("q", F.col("p") + 1 + 4 * F.col("pointers_n"))
    rows = rows.withColumn("bar", F.when(F.get("t", F.lit(2)) == "v", F.col("q") + 1 + 3 * num(F.col("q"))).otherwise(F.col("q")))
    rows = rows.where(F.when(F.get("t", F.col("bar")) == "|", True).otherwise(F.raise_error(F.concat(F.lit("no gloss where it must stand: "), F.col("line"))).cast("boolean")))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = F.create_map(*[F.lit(x) for kv in POINTERS.items() for x in kv])
    key = lambda offset, pos: F.concat_ws("-", offset, pos)

    def pointer(i):
        at = F.col("p") + 1 + 4 * i
        rel = F.element_at(name, F.get("t", at))
        return F.struct(F.coalesce(rel, F.raise_error(F.concat(F.lit("unknown pointer "), F.get("t", at)))).alias("rel"), key(F.get("t", at + 1), F.get("t", at + 2)).alias("to_syn"))

    return rows.select(
        key(F.get("t", F.lit(0)), F.get("t", F.lit(2))).alias("synid"), F.get("t", F.lit(2)).alias("pos"),
        F.transform(every(F.col("words")), lambda i: F.get("t", F.lit(4) + 2 * i)).alias("lexemes"),
        F.transform(every(F.col("pointers_n")), pointer).alias("pointers"),
        F.array_join(F.slice("t", F.col("bar") + 2, F.size("t")), " ").alias("gloss"),
    )


def data_net(synsets: DataFrame) -> tuple[Net, DataFrame]:
    """(net, texts) of ``data_files``: lexemes are units of their own in each synset, all relations are between synsets."""
    one = synsets.select("synid", F.explode("lexemes").alias("form")).distinct()
    unit = F.concat_ws(" ", "synid", "form")
    none = synsets.where("false").selectExpr("synid AS from_lex", "synid AS to_lex", "pos AS rel")
    con = synsets.select(F.col("synid").alias("from_syn"), F.explode("pointers").alias("p")).select("from_syn", F.col("p.to_syn").alias("to_syn"), F.col("p.rel").alias("rel")).distinct()
    net = Net(synsets.select("synid", "pos").distinct(), one.select(unit.alias("lexid"), "synid"), one.select(unit.alias("lexid"), T.normalize(F.col("form")).alias("form")), con, none)
    return net, synsets.select("synid", F.lit("def").alias("kind"), F.col("gloss").alias("txt"))


# --- annotations ----------------------------------------------------------------------


def _document(c: str, suffix: str):
    return F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), suffix, "")


def words_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc, wid, text): words of annotated documents, lower-cased; ``doc`` is the file's name without ``.words.xml``."""
    raw = _xml(spark, "word", "_id STRING, _VALUE STRING", *paths)
    text = F.lower(F.regexp_replace(F.trim("_VALUE"), r"\s+", " "))
    return raw.select(_document("_metadata.file_path", r"\.words\.xml$").alias("doc"), F.regexp_extract("_id", r"(\d+)$", 1).cast("int").alias("wid"), text.alias("text"))


def markable_files(spark: SparkSession, level: str, *paths: str) -> DataFrame:
    """(doc, mid, level, polarity, span, attrs) of ``DOC_LEVEL_level.xml`` files; ``span`` is sorted; elements without a span are left out."""
    raw = _xml(spark, "markable", "_id STRING, _span STRING, _mmax_level STRING, _polarity STRING, _intensity STRING, _sarcasm STRING", *paths)
    names = ["_intensity", "_sarcasm", "_polarity"]
    attrs = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n[1:]), F.col(n))]), lambda _, v: v.isNotNull())
    doc = _document("_metadata.file_path", rf"_{level}_level\.xml$")
    return raw.where("_span <> ''").select(doc.alias("doc"), F.col("_id").alias("mid"), F.coalesce("_mmax_level", F.lit(level)).alias("level"), F.col("_polarity").alias("polarity"), F.array_sort(T.span_to_ids(F.col("_span"))).alias("span"), attrs.alias("attrs"))


def annotated_tokens(words: DataFrame, markables: DataFrame, form2lemma: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens, gold) for evaluation: words in order with their lemmas, and each markable at its last word.

    A markable whose last word is none (no letters in form and lemma) is left
    out.  ``start`` is the span's first word.  An unknown polarity stops the query.
    """
    toks = words.select(F.col("doc").alias("doc_id"), F.lit(0).alias("sent_id"), F.col("wid").alias("pos"), F.col("text").alias("form"))
    if form2lemma is not None:
        one = form2lemma.select("form", "lemma").dropDuplicates(["form"])
        toks = toks.join(one, "form", "left").withColumn("lemma", F.coalesce("lemma", "form"))
    else:
        toks = toks.withColumn("lemma", F.col("form"))
    known = F.when(F.col("polarity").isin("positive", "negative", "neutral"), F.col("polarity")).otherwise(F.raise_error(F.concat(F.lit("unknown polarity "), F.coalesce("polarity", F.lit("")))))
    ends = markables.select(F.col("doc").alias("doc_id"), F.element_at("span", 1).alias("start"), F.element_at("span", -1).alias("pos"), known.alias("class"))
    gold = ends.join(toks.select("doc_id", "sent_id", "pos", "form", "lemma"), ["doc_id", "pos"]).where(T.is_word(F.col("form")) | T.is_word(F.col("lemma")))
    return toks.select("doc_id", "sent_id", "pos", "form", "lemma"), gold.select("doc_id", "sent_id", "start", F.col("pos").alias("end"), "class").distinct()
