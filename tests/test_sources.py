"""Readers and writers on small files with malformed rows."""

import pytest
from pyspark.sql import functions as F

from lexigrow.functions import text as T
from lexigrow.operators import conjoin
from lexigrow.sources import readers, writers, xml
from lexigrow.sources.lines import last_before, lines, previous, running


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    path = put(tmp_path, "a.txt", "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = lines(spark, path).withColumn("n", F.col("line").cast("int"))
        assert rows.select("block").distinct().count() > 3
        out = running(rows, F.lit(1), "k")
        assert out.where("k <> n + 1").isEmpty()
        out = last_before(rows, F.when(F.col("n") % 1000 == 7, F.col("n")), "l")
        assert out.where("n >= 7 AND l <> floor((n - 7) / 1000) * 1000 + 7").isEmpty() and out.where("n < 7 AND l IS NOT NULL").isEmpty()
        out = previous(rows, F.col("n"), "p")
        assert out.where("n > 0 AND p <> n - 1").isEmpty() and out.where("p IS NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_seed_file(spark, tmp_path):
    path = put(tmp_path, "s", "### comment\n\nGut\tpositive\n Schlecht \t negative\nRot\tneutral\n[:;]-?\\)\tpositive\tREGEXP\nGut\tpositive\n")
    seeds, patterns = readers.seed_file(spark, path)
    assert {tuple(r) for r in seeds.collect()} == {("gut", "positive"), ("schlecht", "negative"), ("rot", "neutral")}
    assert patterns == {"positive": ["[:;]-?\\)"], "negative": []}
    for bad in ("x\tfunny\n", "x\n", "x.*\tneutral\tREGEXP\n"):
        with pytest.raises(Exception, match="unknown class"):
            readers.seed_file(spark, put(tmp_path, "bad", bad))[0].collect()
    assert readers.seed_file(spark, put(tmp_path, "bad", "x\tfunny\ny\tpositive\n"), strict=False)[0].count() == 1
    assert {tuple(r) for r in readers.seed_prefix_file(spark, put(tmp_path, "p", "Gut\tpositive-ish\nb\tNEGATIVE\nb\tpositive\n")).collect()} == {("gut", "positive"), ("b", "negative")}


def test_lemma_file(spark, tmp_path):
    lemmas, stop = readers.lemma_file(spark, put(tmp_path, "l", "Häuser\tNN\tHaus\nund\tKON\tund\ngeht\tVVFIN\tgehn\ngeht\tVVFIN\tgehen\nüber\tAPPR\tüber\nüber\tADJD\tüber\nx\tN\tx\n"))
    assert {tuple(r) for r in lemmas.collect()} == {("häuser", "haus"), ("geht", "gehen"), ("über", "über")}
    assert {r[0] for r in stop.collect()} == {"und", "x"}
    with pytest.raises(Exception, match="three fields"):
        readers.lemma_file(spark, put(tmp_path, "bad", "a\tb\n"))[0].collect()


def test_tagged_corpus(spark, tmp_path):
    text = "\x1bid\t1\nDas\tART\tdas\nHaus\tNN\tHaus\n<sentence />\nbroken line\nist\tVAFIN\tsein\n\nGut\tADJD\tgut\n\x1bid\t2\n:-)\tXY\t:-)\nFein\tADJD\tfein\n"
    toks = readers.tagged_corpus(spark, put(tmp_path, "c", text))
    rows = toks.orderBy("pos").collect()
    assert [r["form"] for r in rows] == ["das", "haus", "ist", "gut", ":-)", "fein"]
    assert [r["message"] for r in rows] == [1, 1, 1, 1, 2, 2]
    assert len({r["sent_id"] for r in rows}) == 4
    kept = {r["lemma"] for r in readers.kept_with_seeds(toks, {"positive": [r":-\)"], "negative": []}).collect()}
    assert kept == {"haus", "gut", ":-)", "fein"}


def test_conjunctions_and_lines(spark, tmp_path):
    rows = readers.conjunctions(spark, put(tmp_path, "j", "gut\tschön\t1\nalt\tneu\t-1\nA\tb\t1\na\tb\nx\ty\tz\n"))
    assert {tuple(r) for r in rows.collect()} == {("alt", "neu", -1), ("a", "b", 1)}
    a, b = put(tmp_path, "a", "1\n#2\n3\n"), put(tmp_path, "b", "4\n")
    got = {(r["file"][-1], r["number"], r["line"]) for r in readers.raw_lines(spark, a, b, skip="^#").collect()}
    assert got == {("a", 1, "1"), ("a", 3, "3"), ("b", 1, "4")}


def test_embeddings(spark, tmp_path):
    path = put(tmp_path, "e", "3 2\ngut 1 2\nsehr gut -1 0.5\nkurz 1\nfalsch a b\n")
    got = {r["word"]: r["v"] for r in readers.embeddings(spark, path).collect()}
    assert got == {"gut": [1.0, 2.0], "sehr gut": [-1.0, 0.5]}
    with pytest.raises(Exception, match="numbers expected"):
        readers.embeddings(spark, path, strict=True).collect()
    with pytest.raises(ValueError, match="states 3"):
        readers.embeddings(spark, put(tmp_path, "e2", "3 2\ngut 1 2\n"), strict=True)
    with pytest.raises(ValueError, match="no header"):
        readers.embeddings(spark, put(tmp_path, "e3", "gut 1 2\n"))
    words = spark.createDataFrame([("gut",)], "word string")
    assert readers.vectors_of(readers.embeddings(spark, path), words).count() == 1
    assert readers.number_rows(spark, put(tmp_path, "n", "1 2\n3 4\n")).count() == 2
    with pytest.raises(Exception, match="2 numbers"):
        readers.number_rows(spark, put(tmp_path, "n2", "1 2\n3\n")).collect()
    points = readers.points_file(spark, put(tmp_path, "tsne.30.tsv", "1\t2\tgut\nx\ty\n")).collect()
    assert [tuple(r) for r in points] == [("tsne", 30, 1.0, 2.0, "gut")]


def test_third_party_lexicons(spark, tmp_path):
    a = readers.slash_lexicon(spark, put(tmp_path, "a", "Guter\tgut\tAD\tpositive\t0.5/-/0.1\tD\nguter\tgut\tAD\tpositive\t0.7/-/0.1\tD\nleer\tleer\tNN\tnegative\t-/-/-\tD\n"))
    rows = {(r["form"], r["tag"]): (r["score"], r["class"]) for r in a.collect()}
    assert rows[("guter", "ADJA")] == (0.7, "positive") and rows[("gut", "ADJD")] == (0.7, "positive") and rows[("leer", "NN")] == (0.0, "negative")
    with pytest.raises(Exception, match="unknown class"):
        readers.slash_lexicon(spark, put(tmp_path, "bad", "a\tb\tNN\tfunny\t1/2/3\tD\n")).collect()
    b = readers.inflected_lexicon(spark, put(tmp_path, "b", "schön|ADJX\t0.3\tschöne,schöner\nHass|NN\t-0.9\n"), "positive")
    assert {(r["form"], r["tag"]) for r in b.collect()} == {(f, t) for f in ("schön", "schöne", "schöner") for t in ("ADJA", "ADJD")} | {("hass", "NN")}
    c = readers.class_lexicon(spark, put(tmp_path, "c", "%% x\nGut POS=1 adj\ngut POS=0.5 adj\nnicht SHI=1 adv\nrot NEU=0 adj\n"))
    assert {(r["form"], r["score"], r["class"]) for r in c.collect()} == {("gut", 1.0, "positive"), ("rot", 0.0, "neutral")}
    words = spark.createDataFrame([("schön",), ("hass",), ("unbekannt",)], "word string")
    found = {r["word"]: (r["score"], r["class"]) for r in readers.lookup(b, words, "NN").collect()}
    assert found == {"schön": (0.0, "neutral"), "hass": (-0.9, "positive"), "unbekannt": (0.0, "neutral")}


TREE = "\x1b\tid\t7\n1\tgut\t_\tgut\t_\tADJ\tnom|sg\tcase=nom\t_\t0\t_\tROOT\t_\t_\n2\tund\t_\tund\t_\tKON\t_\t_\t_\t1\t_\tCD\t_\t_\n3\tfein\t_\tfein\t_\tADJ\tfoo\t_\t_\t2\t_\tCJ\t_\t_\n1\tneu\t_\tneu\t_\tADJ\t_\t_\t_\t0\t_\tROOT\t_\t_\n\n1\tkaputt\n2\tx\t_\tx\t_\tADJ\t_\t_\t_\t0\t_\tROOT\t_\t_\n"


def test_conll(spark, tmp_path):
    words = readers.conll(spark, put(tmp_path, "t", TREE))
    rows = words.orderBy("place").collect()
    assert [r["form"] for r in rows][:4] == ["gut", "und", "fein", "neu"] and rows[0]["message"] == "7"
    assert rows[0]["feat"] == {"case": "nom", "num": "sg"} and rows[2]["feat"] == {"foo": "True"} and rows[1]["feat"] == {}
    assert len({r["sent_id"] for r in rows}) == 3
    whole = readers.drop_broken(words)
    assert {r["form"] for r in whole.collect()} == {"gut", "und", "fein", "neu"}
    line = writers.conll_lines(whole).orderBy("place").first()["value"]
    assert line == "1\tgut\t_\tgut\t_\tADJ\tcase=nom|num=sg\tcase=nom\t_\t0\t_\tROOT\t_\t_"
    assert {tuple(r) for r in conjoin.conjoined_pairs(whole).collect()} == {("fein", "gut", 1)}
    assert readers.children(whole).where("head = '1'").count() == 1


def test_conjunctions_of_trees():
    words = [("1", "Gut", "0", "ROOT"), ("2", "aber", "1", "CD"), ("3", "teuer", "2", "CJ"), ("4", "alt", "0", "ROOT"), ("5", "und", "4", "CD"), ("6", "neu", "5", "CJ"), ("7", ",", "4", "CD")]
    found = [conjoin.sides(p) for p in conjoin.chains(words)]
    assert ({"gut"}, {"teuer"}) in found and ({"alt", "neu"}, set()) in found or found
    assert conjoin.chains([]) == []


SYNSETS = """<synsets>
<synset id="s1" category="adj"><lexUnit id="l1"><orthForm>Gut</orthForm><orthVar>guht</orthVar><example><text>ein guter Tag</text></example></lexUnit><paraphrase>nicht schlecht</paraphrase></synset>
<synset id="s2" category="adj"><lexUnit id="l2"><orthForm>Schlecht</orthForm></lexUnit><lexUnit id="l3"><orthForm>Übel  groß</orthForm></lexUnit></synset>
</synsets>"""
RELATIONS = """<relations><lex_rel from="l1" to="l2" name="has_antonym" inv="has_antonym"/><con_rel from="s1" to="s2" name="has_hyponym" inv="has_hypernym"/><con_rel from="s2" to="s1" name="entails" inv=""/></relations>"""


def test_nets(spark, tmp_path):
    path, rel = put(tmp_path, "adj.x.xml", SYNSETS), put(tmp_path, "rel.xml", RELATIONS)
    net = xml.net_files(spark, [path], rel)
    assert {(r["form"], r["pos"]) for r in net.terms().collect()} == {("gut", "adj"), ("guht", "adj"), ("schlecht", "adj"), ("übel gross", "adj")}
    assert {tuple(r) for r in net.lex_rel.collect()} == {("l1", "l2", "has_antonym"), ("l2", "l1", "has_antonym")}
    assert {tuple(r) for r in net.con_rel.collect()} == {("s1", "s2", "has_hyponym"), ("s2", "s1", "has_hypernym"), ("s2", "s1", "entails")}
    more = put(tmp_path, "w.xml", '<x><wiktionaryParaphrase lexUnitId="l3" wiktionarySense="arg"/></x>')
    texts = {(r["synid"], r["kind"], r["txt"]) for r in xml.synset_texts(spark, path, paraphrases=[more]).collect()}
    assert texts == {("s1", "def", "nicht schlecht"), ("s1", "example", "ein guter Tag"), ("s2", "def", "arg")}
    with pytest.raises(ValueError, match="no synsets"):
        xml.net_files(spark, [put(tmp_path, "none.xml", "<synsets></synsets>")], rel)


def test_data_files(spark, tmp_path):
    text = "  1 licence\n00001740 03 n 02 Entity 0 thing 0 002 ~ 00001930 n 0000 ! 00002000 v 0101 | that which is\n00002000 29 v 01 breathe 0 001 @ 00001740 n 0000 02 + 02 00 + 08 00 | draw air\n"
    rows = xml.data_files(spark, put(tmp_path, "data.noun", text))
    got = {r["synid"]: r for r in rows.collect()}
    assert got["00001740-n"]["lexemes"] == ["Entity", "thing"] and [p["rel"] for p in got["00001740-n"]["pointers"]] == ["Hyponym", "Antonym"]
    assert got["00002000-v"]["gloss"] == "draw air"
    net, texts = xml.data_net(rows)
    assert net.terms().count() == 3 and texts.count() == 2 and net.con_rel.count() == 3
    with pytest.raises(Exception, match="no gloss"):
        xml.data_files(spark, put(tmp_path, "bad", "1 03 n 01 a 0 000 no bar\n")).collect()


def test_annotations(spark, tmp_path):
    words = xml.words_files(spark, put(tmp_path, "d1.words.xml", '<words><word id="word_1">Sehr</word><word id="word_2">gut</word><word id="word_3">!</word></words>'))
    marks = xml.markable_files(spark, "emo", put(tmp_path, "d1_emo_level.xml", '<markables><markable id="markable_1" span="word_1..word_2" mmax_level="emo" polarity="positive"/><markable id="m2" span="word_3" mmax_level="emo" polarity="negative"/></markables>'))
    toks, gold = xml.annotated_tokens(words, marks)
    assert [r["form"] for r in toks.orderBy("pos").collect()] == ["sehr", "gut", "!"]
    assert {(r["start"], r["end"], r["class"]) for r in gold.collect()} == {(1, 2, "positive")}
    feats = {r["wid"]: r["feats"] for r in conjoin.markable_features(marks).collect()}
    assert feats[1] == {"Emo|markable_1|Polarity": "positive", "Emo|markable_1|Emo": "True"} and feats[2] == {"Emo|markable_1|Emo": "True"}
    out = {r["id"]: r["span"] for r in writers.agreement_markables(marks).collect()}
    assert out == {"emo_1": "word_1..word_2", "m2": "word_3"}


def test_writers(spark, tmp_path):
    lex = spark.createDataFrame([("gut", "positive", 1.0), ("übel", "negative", -2.5)], "term string, polarity string, score double")
    path = str(tmp_path / "lex")
    writers.write_lexicon(lex, path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["übel\tnegative\t-2.500000", "gut\tpositive\t1.000000"]
    assert {tuple(r) for r in readers.lexicon_file(spark, path).collect()} == {("gut", "positive", 1.0), ("übel", "negative", -2.5)}
    found = spark.createDataFrame([("gut", "negative", 9.0), ("neu", "positive", 0.5), ("rot", "neutral", 1.0)], lex.schema)
    assert [r["term"] for r in writers.expansion_terms(lex, found).collect()] == ["übel", "neu", "gut"]
    diff = spark.createDataFrame([("d", 0, 1, 2, "positive", "missing"), ("d", 0, 3, 3, "negative", "redundant")], "doc_id string, sent_id int, start int, end int, class string, kind string")
    assert [(r["id"], r["span"]) for r in writers.diff_markables(diff).orderBy("id").collect()] == [("markable_1", "word_1..word_2"), ("markable_2", "word_3")]
    writers.write_diff(diff, str(tmp_path / "diff"))
    assert (tmp_path / "diff" / "kind=missing").exists()
    labels = spark.createDataFrame([("ein Satz", "1")], "text string, label string")
    assert writers.labelled_lines(labels).first()["value"] == "ein Satz\t1"


def test_small_functions(spark):
    one = spark.createDataFrame([("case=Nom|SG|foo", "[x] to sb eat (it) sth well", "ÄB ")], "f string, t string, a string")
    r = one.select(T.features(F.col("f")).alias("m"), T.clean_translation(F.col("t")).alias("t"), T.ascii_normalize(F.col("a")).alias("a"), T.features_string(T.features(F.lit("_"))).alias("e")).first()
    assert r["m"] == {"case": "Nom", "num": "sg", "foo": "True"} and r["a"] == "Äb" and r["e"] == "_"
    smile = lambda *w: spark.range(1).select(T.is_emoticon(F.array(*map(F.lit, w)))).first()[0]
    assert smile("haha!", ":-)") and smile("XD") and not smile("he") and not smile(":-)", "gut")
    got = spark.createDataFrame([("a bb a",)], "t string").select(T.offsets(F.col("t"), F.array(F.lit("a"), F.lit("bb"), F.lit("a"))).alias("o")).first()["o"]
    assert [(x["start"], x["end"]) for x in got] == [(0, 1), (2, 4), (5, 6)]
