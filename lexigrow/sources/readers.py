"""Readers of seeds, dictionaries, corpora, embeddings and third-party lexicons.

Malformed rows follow the source's kind: corpora, conjunctions and embeddings
skip them; seeds, dictionaries and lexicons stop the read (``strict=False``
skips them there too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import ESCAPE, PLACE, SENTENCE, field_list, last_before, lines, running, strip, stripped

POLARITIES = ("positive", "negative", "neutral")


def _checked(rows: DataFrame, right: Column, what: str, strict: bool) -> DataFrame:
    """Rows for which ``right`` holds; with ``strict`` any other row stops the query."""
    right = F.coalesce(right, F.lit(False))
    if not strict:
        return rows.where(right)
    return rows.where(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.col("line"))).cast("boolean")))


# --- seeds and dictionaries ----------------------------------------------------


def seed_file(spark: SparkSession, *paths: str, strict: bool = True) -> tuple[DataFrame, dict[str, list[str]]]:
    """(seeds(term, polarity), expressions by class) of ``term TAB class [TAB REGEXP]`` lines; ``###`` begins a comment.

    Expressions are allowed for the polar classes alone.  A seed set is written
    by hand: its expressions come to the driver.
    """
    f = field_list()
    rows = stripped(spark, *paths).where(~F.col("line").startswith("###")).withColumn("f", f)
    regex = (F.size("f") > 2) & (F.get("f", F.lit(2)) == "REGEXP")
    rows = rows.withColumn("polarity", F.get("f", F.lit(1))).withColumn("regex", F.coalesce(regex, F.lit(False)))
    known = F.col("polarity").isin(*POLARITIES) & ~(F.col("regex") & (F.col("polarity") == "neutral"))
    rows = _checked(rows, known, "unknown class", strict)
    seeds = rows.where(~F.col("regex")).select(T.normalize(F.get("f", F.lit(0))).alias("term"), "polarity").distinct()
    patterns: dict[str, list[str]] = {"positive": [], "negative": []}
    for r in rows.where("regex").select(F.get("f", F.lit(0)).alias("p"), "polarity", *PLACE).orderBy(*PLACE).collect():
        patterns[r["polarity"]].append(r["p"])
    return seeds, patterns


def seed_prefix_file(spark: SparkSession, *paths: str) -> DataFrame:
    """(term, polarity) by the vector tools' rule: the class is known by how it begins, the first entry of a term counts, no expressions."""
    rows = stripped(spark, *paths).where(~F.col("line").startswith("###")).withColumn("f", field_list())
    named = F.lower(F.coalesce(F.get("f", F.lit(1)), F.lit("")))
    polarity = F.coalesce(*[F.when(named.startswith(k), k) for k in POLARITIES])
    rows = _checked(rows.withColumn("polarity", polarity), polarity.isNotNull(), "unknown class", True)
    first = F.min_by("polarity", F.struct(*PLACE))
    return rows.groupBy(F.lower(F.trim(F.get("f", F.lit(0)))).alias("term")).agg(first.alias("polarity"))


def lemma_file(spark: SparkSession, *paths: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(form2lemma(form, lemma), stop(form)) of ``form TAB tag TAB lemma``: forms of uninformative tags are stop words.

    Of a form's lemmas the last in file order counts; a lemma beats a stop word.
    """
    rows = stripped(spark, *paths).withColumn("f", field_list())
    rows = _checked(rows, F.size("f") == 3, "three fields expected", strict)
    rows = rows.select(T.normalize(F.get("f", F.lit(0))).alias("form"), F.get("f", F.lit(1)).alias("tag"), T.normalize(F.get("f", F.lit(2))).alias("lemma"), *PLACE)
    content = (F.length("tag") > 1) & T.informative(F.col("tag"))
    lemmas = rows.where(content).groupBy("form").agg(F.max_by("lemma", F.struct(*PLACE)).alias("lemma"))
    stop = rows.where(~content).select("form").distinct().join(lemmas, "form", "left_anti")
    return lemmas, stop


def table_file(spark: SparkSession, *paths: str) -> DataFrame:
    """(term, value): the first two tab fields of each line, ``#`` comments cut off; a line of one field is left out."""
    rows = lines(spark, *paths).withColumn("line", strip(F.regexp_replace("line", r"(?:^|\s+)#.*$", ""))).where("line <> ''").withColumn("f", field_list())
    return rows.where(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("term"), F.get("f", F.lit(1)).alias("value"))


def lexicon_file(spark: SparkSession, *paths: str) -> DataFrame:
    """(term, polarity, score) as ``write_lexicon`` writes it; a missing score is null."""
    rows = stripped(spark, *paths).withColumn("f", field_list()).where(F.size("f") >= 2)
    return rows.select(F.get("f", F.lit(0)).alias("term"), F.get("f", F.lit(1)).alias("polarity"), F.get("f", F.lit(2)).try_cast("double").alias("score"))


# --- corpora --------------------------------------------------------------------


def tagged_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, doc_id, sent_id, pos, form, tag, lemma) of ``form TAB tag TAB lemma`` lines, lower-cased.

    A line that begins with ESC begins a message (``doc_id``); such a line, a
    blank one or ``<sentence />`` begins a sentence (``sent_id``).  Lines of other
    than three fields are skipped.  ``pos`` rises within the file.
    """
    rows = lines(spark, *paths).withColumn("line", F.lower(strip("line")))
    message = F.col("line").startswith(ESCAPE)
    sentence = message | (F.col("line") == "") | F.col("line").rlike(SENTENCE)
    cut = rows.withColumn("_m", message).withColumn("_s", sentence)
    units = running(running(cut, F.when(F.col("_m"), 1).otherwise(0), "message"), F.when(F.col("_s"), 1).otherwise(0), "sent_id")
    toks = units.where("NOT _s").withColumn("f", field_list()).where(F.size("f") == 3)
    # ids of messages are unique over files
    doc = F.xxhash64("file", "message")
    return toks.select(
        "file", doc.alias("doc_id"), "message", "sent_id", F.struct("block", "row").alias("pos"), F.get("f", F.lit(0)).alias("form"), F.get("f", F.lit(1)).alias("tag"), T.normalize(F.get("f", F.lit(2))).alias("lemma")
    )


def kept_with_seeds(toks: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """Informative plain words, and whatever a seed expression matches by form or lemma."""
    from ..operators.corpus import seed_match

    return toks.where(seed_match(patterns, "form") | seed_match(patterns, "lemma") | (T.informative(F.col("tag")) & T.check_word(F.col("lemma"))))


def conjunctions(spark: SparkSession, *paths: str) -> DataFrame:
    """(a, b, w) of ``word TAB word TAB 1 or -1``; other lines, and words that aren't plain, are skipped."""
    rows = stripped(spark, *paths).withColumn("f", field_list()).where(F.size("f") == 3)
    out = rows.select(T.normalize(F.get("f", F.lit(0))).alias("a"), T.normalize(F.get("f", F.lit(1))).alias("b"), F.get("f", F.lit(2)).try_cast("int").alias("w"))
    return out.where("w IS NOT NULL").where(T.check_word(F.col("a")) & T.check_word(F.col("b")))


def raw_lines(spark: SparkSession, *paths: str, skip: str | None = None) -> DataFrame:
    """(file, number, line) over any number of files, counted per file; lines that match ``skip`` count but are left out."""
    out = running(lines(spark, *paths), F.lit(1), "number").select("file", "number", "line")
    return out if skip is None else out.where(~F.col("line").rlike(skip))


# --- vectors -----------------------------------------------------------------------


def embeddings(spark: SparkSession, *paths: str, dims: int | None = None, strict: bool = False) -> DataFrame:
    """(id, word, v): a ``rows dims`` header, then words (blanks allowed) and, last, ``dims`` numbers.

    Rows of another make are skipped, or with ``strict`` stop the query, as does a
    count of rows that the header doesn't state.  Without ``dims`` the header is
    read first.
    """
    header = r"^\s*\d+\s+\d+\s*$"
    rows = stripped(spark, *paths)
    stated = None
    if dims is None or strict:
        head = rows.where(F.col("line").rlike(header)).orderBy(*PLACE).select("line").first()
        if head is None:
            raise ValueError("no header of rows and dimensions")
        stated, dims = (int(x) for x in head["line"].split())
    rows = rows.where(~F.col("line").rlike(header)).withColumn("f", F.split("line", r"\s+"))
    v = F.transform(F.slice("f", F.greatest(F.size("f") - dims + 1, F.lit(1)), dims), lambda x: x.try_cast("double"))
    rows = rows.withColumn("v", v)
    right = (F.size("f") > dims) & ~F.exists("v", lambda x: x.isNull())
    rows = _checked(rows, right, f"a word and {dims} numbers expected", strict)
    if strict and rows.count() != stated:
        raise ValueError(f"the header states {stated} rows")
    word = F.array_join(F.slice("f", 1, F.greatest(F.size("f") - dims, F.lit(1))), " ")
    return rows.select(F.xxhash64(*PLACE).alias("id"), word.alias("word"), "v")


def vectors_of(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """Only the vectors of the requested ``words(word)``."""
    return vectors.join(words.select("word").distinct(), "word", "left_semi")


def number_rows(spark: SparkSession, *paths: str, dims: int | None = None) -> DataFrame:
    """(id, v) of rows of numbers, all of one width: another width stops the query."""
    rows = stripped(spark, *paths).withColumn("f", F.split("line", r"\s+"))
    if dims is None:
        first = rows.orderBy(*PLACE).select(F.size("f")).first()
        dims = first[0] if first else 0
    v = F.transform("f", lambda x: x.try_cast("double"))
    rows = _checked(rows.withColumn("v", v), (F.size("f") == dims) & ~F.exists("v", lambda x: x.isNull()), f"{dims} numbers expected", True)
    return rows.select(F.xxhash64(*PLACE).alias("id"), "v")


def points_file(spark: SparkSession, *paths: str) -> DataFrame:
    """(kind, perplexity, x, y, label) of tab-separated points; kind and perplexity come from the file's name, as ``kind.30.tsv``."""
    rows = stripped(spark, *paths).withColumn("f", field_list()).where(F.size("f") >= 2)
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    out = rows.select(F.regexp_extract(name, r"^([^.]+)", 1).alias("kind"), F.regexp_extract(name, r"\.(\d+)(?:\.|$)", 1).try_cast("int").alias("perplexity"), F.get("f", F.lit(0)).try_cast("double").alias("x"), F.get("f", F.lit(1)).try_cast("double").alias("y"), F.get("f", F.lit(2)).alias("label"))
    return out.where("x IS NOT NULL AND y IS NOT NULL")


# --- third-party lexicons -----------------------------------------------------------


def _strongest(rows: DataFrame) -> DataFrame:
    """Of a form's entries of one class and tag that of greatest absolute score."""
    best = F.max_by(F.struct("lemma", "score"), F.struct(F.abs("score"), F.col("lemma")))
    return rows.groupBy("source", "form", "tag", "class").agg(best.alias("b")).select("source", "form", "b.lemma", "tag", "b.score", "class")


def slash_lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, form, lemma, tag, score, class) of six columns: form, lemma, tag, class, ``positive/negative/neutral`` scores, one more.

    The score is that of the class; ``-`` is 0; the tag AD stands for ADJA and
    ADJD; a lemma is a form of its own.
    """
    rows = stripped(spark, *paths).withColumn("f", field_list())
    place = F.array_position(F.array(*map(F.lit, POLARITIES)), F.get("f", F.lit(3)))
    rows = _checked(rows.where(F.size("f") == 6), place > 0, "unknown class", True)
    part = F.element_at(F.split(F.get("f", F.lit(4)), "/"), place.cast("int"))
    tags = F.when(F.get("f", F.lit(2)) == "AD", F.array(F.lit("ADJA"), F.lit("ADJD"))).otherwise(F.array(F.get("f", F.lit(2))))
    form, lemma = T.normalize(F.get("f", F.lit(0))), T.normalize(F.get("f", F.lit(1)))
    out = rows.select(F.get("f", F.lit(3)).alias("class"), F.when(part == "-", 0.0).otherwise(part.try_cast("double")).alias("score"), F.explode(tags).alias("tag"), lemma.alias("lemma"), F.array_distinct(F.array(form, lemma)).alias("forms"))
    return _strongest(out.select(F.lit("slash").alias("source"), F.explode("forms").alias("form"), "lemma", "tag", "score", "class"))


def inflected_lexicon(spark: SparkSession, path: str, polarity: str) -> DataFrame:
    """The same of ``word|TAG TAB score TAB form,form`` lines of one class; ADJX stands for ADJA and ADJD, the inflections are optional."""
    rows = stripped(spark, path).withColumn("f", field_list())
    rows = _checked(rows, (F.size("f") >= 2) & F.get("f", F.lit(0)).contains("|") & F.get("f", F.lit(1)).try_cast("double").isNotNull(), "word|TAG and a score expected", True)
    head = F.split(F.get("f", F.lit(0)), r"\|")
    tags = F.when(F.get(head, F.lit(1)) == "ADJX", F.array(F.lit("ADJA"), F.lit("ADJD"))).otherwise(F.array(F.get(head, F.lit(1))))
    forms = F.filter(F.split(F.coalesce(F.get("f", F.lit(2)), F.lit("")), " *, *"), lambda x: x != "")
    word = T.normalize(F.get(head, F.lit(0)))
    out = rows.select(word.alias("lemma"), F.get("f", F.lit(1)).try_cast("double").alias("score"), F.explode(tags).alias("tag"), F.array_distinct(F.concat(F.transform(forms, T.normalize), F.array(word))).alias("forms"))
    return _strongest(out.select(F.lit("inflected").alias("source"), F.explode("forms").alias("form"), "lemma", "tag", "score", F.lit(polarity).alias("class")))


def class_lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """The same of ``form CLASS=score`` lines; ``%%`` begins a comment; shifters and intensifiers are left out, other classes stop the query."""
    rows = stripped(spark, *paths).where(~F.col("line").startswith("%%")).withColumn("f", F.split("line", r"\s+"))
    value = F.split(F.coalesce(F.get("f", F.lit(1)), F.lit("")), "=")
    rows = _checked(rows.withColumn("k", F.get(value, F.lit(0))).withColumn("s", F.get(value, F.lit(1)).try_cast("double")), F.col("k").isin("POS", "NEG", "NEU", "SHI", "INT") & F.col("s").isNotNull(), "unknown class", True)
    named = F.when(F.col("k") == "POS", "positive").when(F.col("k") == "NEG", "negative").when(F.col("k") == "NEU", "neutral")
    form = T.normalize(F.get("f", F.lit(0)))
    out = rows.select(F.lit("class").alias("source"), form.alias("form"), form.alias("lemma"), F.lit("NONE").alias("tag"), F.col("s").alias("score"), named.alias("class")).where("class IS NOT NULL")
    return _strongest(out)


def lookup(lexicon: DataFrame, words: DataFrame, tag: str | None = None) -> DataFrame:
    """(word, tag, score, class) of ``words(word)``; what isn't there, or not with that tag, is neutral with score 0."""
    held = lexicon.select(F.col("form").alias("word"), "tag", "score", "class")
    held = held.where(F.col("tag") == tag) if tag else held
    best = held.groupBy("word").agg(F.max_by(F.struct("tag", "score", "class"), F.struct(F.abs("score"), F.col("class"), F.col("tag"))).alias("b"))
    out = words.select("word").distinct().join(best, "word", "left")
    return out.select("word", F.coalesce("b.tag", F.lit(tag)).alias("tag"), F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce("b.class", F.lit("neutral")).alias("class"))


# --- trees -----------------------------------------------------------------------------

COLUMNS = ["idx", "form", "lemma", "plemma", "pos", "ppos", "feat", "pfeat", "head", "phead", "deprel", "pdeprel", "fillpred", "pred"]


def conll(spark: SparkSession, *paths: str, extra: int = 0) -> DataFrame:
    """(file, message, sent_id, 14 columns, extra): a row per word of tab-separated dependency trees.

    ESC lines hold metadata, and one with the key ``id`` names the message that
    follows.  A sentence begins after a blank line or ``<sentence />``, and where
    the index falls.  Feature columns become maps.  A line of fewer than 14
    fields, or of more than 14 and ``extra``, marks its sentence as broken:
    ``drop_broken`` leaves out such sentences whole.
    """
    rows = lines(spark, *paths).withColumn("line", strip("line"))
    meta = F.col("line").startswith(ESCAPE)
    f = F.split("line", "\t")
    rows = rows.withColumn("f", f).withColumn("_meta", meta).withColumn("_end", (F.col("line") == "") | F.col("line").rlike(SENTENCE) | meta)
    named = F.when(meta & (F.get(F.split("line", r"\t+"), F.lit(1)) == "id"), F.get(F.split("line", r"\t+"), F.lit(2)))
    rows = last_before(rows, named, "message")
    rows = running(rows, F.when(F.col("_end"), 1).otherwise(0), "_unit").where("NOT _end")
    idx = F.get("f", F.lit(0)).try_cast("int")
    at = Window.partitionBy("file", "_unit").orderBy("block", "row")
    falls = F.coalesce(idx < F.lag(idx).over(at), F.lit(False))
    rows = rows.withColumn("_falls", falls).withColumn("_part", F.sum(F.when(F.col("_falls"), 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("sent_id", F.struct(F.col("_unit").alias("unit"), F.col("_part").alias("part"))).withColumn("broken", ~F.size("f").between(14, 14 + extra) | idx.isNull())
    values = [T.features(F.get("f", F.lit(i))).alias(c) if c in ("feat", "pfeat") else F.get("f", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)]
    more = F.slice("f", 15, F.greatest(F.size("f") - 14, F.lit(0)))
    return rows.select("file", "message", "sent_id", F.struct("block", "row").alias("place"), *values, more.alias("extra"), "broken")


def drop_broken(words: DataFrame) -> DataFrame:
    """Trees without the sentences that hold a malformed line."""
    by = Window.partitionBy("file", "sent_id")
    return words.withColumn("_b", F.max("broken").over(by)).where("NOT _b").drop("_b", "broken")


def children(words: DataFrame) -> DataFrame:
    """(file, sent_id, head, idx): each word below the one that its predicted head names."""
    return words.select("file", "sent_id", F.col("phead").alias("head"), "idx")
