"""The ten document operators on small tables: brute force, round trips, odd rows."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from lexigrow.llm import chat, decontam, fingerprint, langid, lm_score, mixing, near_dedup, pii, quality, registry, token_count

SF = "/root/testdata/sf0.001"
ODD = [(None, "a lone text without an id", None, None), (1, None, None, "src0"), (2, "", "en", None), (3, " \t\n", "en", "src0"), (4, "same words here again", "en", "src1"), (4, "same words here again", "en", "src1"), (5, "long " * 30_000, "de", "src0"), (6, "\U0001f600 ça ß", "fr", "src2")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_odd_rows(spark, odd):
    assert pii.find_pii(odd).count() == 8
    assert near_dedup.dedup_query(odd).count() == 8
    assert token_count.token_counts(odd).where("doc_id = 1").first()["n_tokens"] == 0
    assert fingerprint.fingerprint_neighbours(odd).count() == 8
    assert {r["doc_id"] for r in lm_score.lm_scores(odd).collect()} == {None, 4, 5, 6}
    assert mixing.mixing_query(odd).where("n_tokens = 0").count() == 0
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert decontam.contaminated(odd, bench).isEmpty()
    assert decontam.decontam_stage(odd, bench).count() == 8
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_query(odd, labels).count() == 8


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for fn in (pii.find_pii, near_dedup.dedup_query, mixing.mixing_query, langid.language_query, lm_score.lm_scores, token_count.token_counts, fingerprint.fingerprint_neighbours):
        assert fn(none).isEmpty()


def test_pii_base_is_the_contract(docs):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def right(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for r in docs.collect():
        spans = [(k, *m.span()) for k, p in base.items() for m in re.finditer(p, r["text"] or "") if right(k, m[0])]
        mine = got[r["doc_id"]]
        assert mine["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(mine["spans"].split(",")) | {""}
        assert mine["n_card"] == sum(k == "card" for k, *_ in spans)


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def near_copies(count, words, seed):
    """A chain of near copies whose ends are far apart, copies of it, and strangers."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{x}" for x in rng.integers(0, 10_000, words)], []
    for i in range(count):
        w = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, max(2, words // 25)))):
            w[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            base = w
    rows += [(count + i, rows[i][1].upper()) for i in range(5)] + [(count + 9, " ".join(f"s{x}" for x in rng.integers(0, 10_000, words)))]
    return rows


@pytest.mark.parametrize("words", [60, 900])
def test_near_dedup_is_brute_force(spark, words):
    rows = near_copies(150, words, words)
    got = near_dedup.dedup_query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_sketches_merge():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64)
    assert (near_dedup.merge(near_dedup.sketch(a), near_dedup.sketch(b)) == near_dedup.sketch(np.union1d(a, b))).all()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|> <\\|im_start|>"), (1, 1, "assistant", "ok <|im_start|>x"), (2, 0, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_query(df).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:2]).encode()).hexdigest()
    assert got[1]["loss_chars"] == len(rows[1][3]) and got[2]["loss_chars"] == 0
    assert got[-1]["loss_sha256"] == hashlib.sha256(chat.TRICK.encode()).hexdigest() and got[None]["n_turns"] == 1
    last = lambda turns: "".join(f"[{r}]{t}" + ("!" if i == len(turns) - 1 else "") for i, (r, t) in enumerate(turns))
    assert [r["rewrites_history"] for r in chat.formatted_turns(df.where("conv_id = 1"), last).orderBy("position").collect()] == [False, True]


def test_decontamination_finds_edited_passages(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil the kettle for tea"
    edited = item.replace("quick", "quikc").replace("seven", "eight")
    rows = [(1, "x " * 50 + item.upper() + " y" * 20), (2, "intro " + edited + " end"), (3, "the quick brown fox sleeps near a river and nothing else happens at all today"), (4, None)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r["doc_id"]: r["edits"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(found) == {1, 2} and found[1] == 0


def test_token_counts_are_the_tokenizers(docs):
    import sentencepiece

    vocab = [("▁a", -1.0), ("▁", -2.0), ("a", -1.5), ("b", -1.5), ("ab", -2.0), ("ba", -3.0), ("aba", -3.5)]
    counter = token_count.Counter(vocab)

    def brute(s):
        best = {0: (0.0, 0)}
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                score = dict(vocab).get(s[i:j])
                if i in best and score is not None and (j not in best or best[i][0] + score > best[j][0]):
                    best[j] = (best[i][0] + score, best[i][1] + 1)
        return best[len(s)][1]

    for text in ("ab", "aba", "abab baab", "bbaa  ab"):
        assert counter.count(text) == brute("▁" + text.replace(" ", "▁"))
    assert sentencepiece and token_count.token_counts(docs).count() == docs.count()


def test_learned_scores_on_held_out_rows(spark, docs):
    lang = langid.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert (lang["lang"] == lang["lang_pred"]).mean() > 0.85
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.quality_query(docs, labels).join(labels.where("quality IS NOT NULL"), "doc_id").where("held_out").toPandas()
    assert (good["quality"] == good["predicted"]).mean() > 0.8


def test_fingerprints(docs):
    rows = fingerprint.fingerprint_neighbours(docs).toPandas().sort_values("doc_id", ascending=False, ignore_index=True)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = rows["doc_id"].tolist()
    for i, d in enumerate(order):
        want = fingerprint.edited(texts[d], texts[order[(i + 1) % len(order)]])
        assert rows["edited_sha256"][i] == hashlib.sha256(want.encode()).hexdigest()
    long = rows[rows["n_chars"] > 300]
    assert long["near_edited"].mean() > long["near_next"].mean() + 0.3
    assert len({texts[d] for d in order}) >= rows["fingerprint"].nunique()


def test_near_pairs_is_brute_force(spark):
    base = "a fairly long sentence about very little that goes on for a while and then stops again"
    rows = [(1, base), (2, base), (3, base.replace("little", "Little")), (4, "something else entirely, with no likeness to the others at all, one hopes")]
    members, links = fingerprint.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {(r["a"], r["b"]) for r in links.collect()} <= {(1, 3)}


def test_pipeline_keeps_columns_and_drops_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out = out.persist()
        assert 0 < out.count() <= n
        n, docs = out.count(), out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("copies < 1").isEmpty()
    assert set(registry.oracle_sql()) <= set(registry.queries())
