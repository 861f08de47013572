"""The document operators in full: the tokenizers' own counts, brute force over small tables, numeric checks of the models."""

import itertools
import math
from hashlib import md5, sha256

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lexigrow.llm import chat, decontam, fingerprint, langid, lm_score, mixing, nn, pii, quality, token_count

SF = "/root/testdata/sf0.001"


def test_token_counts_are_the_models_own(spark):
    import sentencepiece

    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", "  a   b ", "▁x<0x0A>\n\U0001f600é中文", "x" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(df).collect()}
    own = sentencepiece.SentencePieceProcessor(model_file=f"{token_count.TOKENIZERS}/{token_count.MODEL}")
    assert got == {i: len(own.encode(t)) for i, t in enumerate(texts)}


def test_near_pairs_misses_none(spark):
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    texts = []
    for i in range(45):
        n = int(rng.integers(9, 40)) if i % 3 == 0 else int(rng.integers(100, 400))
        a = rng.choice(letters, n).tolist()
        b = list(a)
        for _ in range(int(n * (0.03, 0.06, 0.09, 0.1)[i % 4])):
            at = int(rng.integers(0, len(b)))
            b[at : at + int(rng.integers(0, 2))] = [str(rng.choice(letters))] * int(rng.integers(0, 2))
        texts += ["".join(a), "".join(b)]
    _, links = fingerprint.near_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {(i, j) for j in range(len(texts)) for i in range(j) if texts[i] != texts[j] and fingerprint.edit_similarity(texts[i], texts[j], 0.9) >= 0.9}
    assert len(want) > 30
    assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_chat_renders_true_prefixes(spark):
    def counted(turns):  # numbers its turns, and the 20th rewrites the first
        return "".join(f"{i}{'!' if i == 0 and len(turns) >= 20 else ':'}{r}={t};" for i, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(25)], "conv_id long, turn long, role string, text string")
    rows = chat.formatted_turns(df, counted).orderBy("position").collect()
    assert [r["rewrites_history"] for r in rows] == [k == 19 for k in range(25)]
    assert [r["span"] for r in rows if r["position"] not in (0, 19)] == [f"{k}:user=t{k};" for k in range(25) if k not in (0, 19)]


def test_chat_renders_every_prefix_of_every_template(spark):
    seen = set()

    def numbered(turns):  # what it says of itself doesn't count
        seen.add(len(turns))
        return "".join(f"[{i}:{r}]{t}</{r}>" for i, (r, t) in enumerate(turns))

    numbered.history_free = True
    rendering = chat.Rendering(numbered)
    spans = [rendering.add("user", f"t{k}")[0] for k in range(40)]
    assert spans == [f"[{k}:user]t{k}</user>" for k in range(40)] and seen == set(range(1, 41))
    last = lambda turns: "".join(t for _, t in turns) + "!"  # noqa: E731  the end mark goes on to the next turn
    rendering = chat.Rendering(last)
    assert [rendering.add("user", t) for t in ("hi", "!x")] == [("hi!", 0, 2, False), ("!x!", 0, 2, True)]
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "user", "!x")], "conv_id long, turn long, role string, text string")
    got = chat.format_digests(df, last, role_of=lambda span: "user", plain=lambda t: t).first()
    assert got["formatted_chars"] == len("hi!x!") and got["turns_sha256"] == sha256(b"user\nhi\nuser\n!x\n").hexdigest()
    long = chat.chat_query(spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], f"<|im_end|>{k}") for k in range(40)], df.schema)).where("conv_id = 1").first()
    said = "".join(f"<|im_end|>{k}" for k in range(1, 40, 2))
    assert long["loss_sha256"] == sha256(said.encode()).hexdigest() and long["n_turns"] == 40 and long["n_rewrites"] == 0


def test_unigram_counts_are_an_independent_encoders(spark):
    from tokenizers import Tokenizer, decoders, models, normalizers

    vocab = token_count.vocabulary()
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    tok.decoder = decoders.Metaspace()
    texts = [(r["text"] or "")[:3000] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["  a   b ", "\U0001f600é中文", "ab" * 500]
    counter = token_count.Counter(vocab)
    for text in texts:
        marked = "▁" + text.replace(" ", "▁")
        want = 0
        for token, (a, z) in zip(tok.encode(text).ids, tok.encode(text).offsets):
            want += 1 if token else len(text[a:z].encode()) if a < z else len(marked[a:z].encode())
        assert counter.count(text) == (want if text else 0)


def brute_scores(rows):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("documents", frame)
    return {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_words, n_known_bigrams, n_unseen, logprob, score FROM ({lm_score.LM_SQL})").fetchall()}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_repeated_ids_are_one_document(spark, chunk):
    rows = [(1, "a b c d"), (1, "a b c e"), (2, "a b x y"), (3, "q r s"), (4, "a a a a b"), (4, "a a"), (5, ""), (6, None), (7, "A\tB c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in lm_score.lm_scores(df, chunk_words=chunk).collect()}
    want = brute_scores(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-4) for k in want)


def brute_found(item, text):
    """Whether a part of the text is within the item's budget, by the full table."""
    a, b = decontam.codes(item.strip()), decontam.codes(text)
    row = np.zeros(len(b) + 1, int)
    for i, ch in enumerate(a, 1):
        new = [i]
        for j in range(1, len(b) + 1):
            new.append(min(row[j - 1] + (b[j - 1] != ch), row[j] + 1, new[-1] + 1))
        row = np.array(new)
    return row.min() <= decontam.budget(len(a))


def test_decontamination_is_brute_force():
    rng = np.random.default_rng(5)
    letters = list("abcdefghij ")
    items = [(i, "".join(rng.choice(letters, int(rng.integers(20, 120))))) for i in range(12)]
    index = decontam.build(items)
    for k in range(60):
        i, item = items[k % len(items)]
        part = list(item.strip())
        for _ in range(int(rng.integers(0, 2 * decontam.budget(len(part)) + 2))):
            at = int(rng.integers(0, len(part)))
            part[at : at + int(rng.integers(0, 2))] = list(rng.choice(letters, int(rng.integers(0, 2))))
        text = "".join(rng.choice(letters, 200)) + "".join(part).upper() + "".join(rng.choice(letters, 200))
        found = decontam.find(index, text)
        assert {j for j, t in items if brute_found(t, text)} == set(found)


def test_decontamination_of_repetitive_and_short_items(spark):
    index = decontam.build([(1, "a" * 160), (2, "short one"), (3, "x" * 170)])
    found = decontam.find(index, "a" * 30_000 + " A Short\tone.")
    assert found[1] == (0, 0, 160) and found[2][0] == 0 and 3 not in found
    assert 2 not in decontam.find(index, "a short ones")
    bench = spark.createDataFrame([(1, "tiny"), (2, None), (3, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a tiny text"), (2, "tinyness"), (3, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == {(1, 1)}


def test_added_spans_of_fresh_forms():
    """Recall and precision of the tagger on forms that the base expressions miss, from seeds that it wasn't taught with."""
    rng, weights = np.random.default_rng(2024), pii.train()
    hit = planted = 0
    for _ in range(160):
        kind = pii.KINDS[int(rng.integers(4))]
        form = pii._sample(rng, kind)
        text = pii._prose(rng, 60) + " " + form + ". " + pii._prose(rng, 60)
        base = pii.base_spans(text)
        at = text.index(form)
        if any(a < at + len(form) and at < b for _, a, b in base):
            continue
        planted += 1
        hit += any(k == kind and a < at + len(form) and at < b for k, a, b in pii.tagged_spans(weights, [text], [base])[0])
    clean = ["Chapter 12 of 2019, page 3-4, version 1.2.3 at 10:30:15 and 5,000 pieces @home " + pii._prose(rng, 80) for _ in range(40)]
    wrong = sum(len(s) for s in pii.tagged_spans(weights, clean, [pii.base_spans(t) for t in clean]))
    assert planted > 40 and hit / planted > 0.7 and wrong <= 2


def test_windows_hold_every_span():
    text = "1 " * 400
    for span in (2, 33, 60, pii.LONGEST):
        for at in range(0, len(text) - span, 7):
            assert any((a == 0 or a < at) and (b == len(text) or at + span < b) for a, b in pii.windows(text) if a <= at and at + span <= b)


def test_chain_is_enumeration():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    paths = list(itertools.product(range(3), repeat=4))
    score = [sum(e[i, 0, p[i]] for i in range(4)) + sum(t[p[i], p[i + 1]] for i in range(3)) for p in paths]
    assert tuple(nn.crf_viterbi(e, t)[:, 0]) == paths[int(np.argmax(score))]
    z = sum(map(math.exp, score))
    want = np.array([[sum(math.exp(s) for p, s in zip(paths, score) if p[i] == k) / z for k in range(3)] for i in range(4)])
    assert np.allclose(nn.crf_marginals(e, t)[:, 0], want)
    lines, trans, starts = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 3, 5])
    good = quality.good_marginals(lines, starts, trans)
    for a, b in ((0, 3), (3, 5)):
        paths = list(itertools.product(range(2), repeat=b - a))
        w = [math.exp(sum(lines[a + i] * p[i] for i in range(b - a)) + sum(trans[p[i], p[i + 1]] for i in range(b - a - 1))) for p in paths]
        assert np.allclose(good[a:b], [sum(x for p, x in zip(paths, w) if p[i]) / sum(w) for i in range(b - a)])


@pytest.mark.parametrize("gates", [3, 4])
def test_gradients_are_numeric(gates):
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in nn.init_recurrent(rng, 5, 3, gates, 2).items()}
    x, y = rng.integers(0, 5, (4, 2)), rng.integers(0, 2, (4, 2))

    def loss(q):
        e = nn.emissions(q, x).astype(np.float64)
        return -sum(e[i, j, y[i, j]] - math.log(np.exp(e[i, j]).sum()) for i in range(4) for j in range(2))

    def slope(e):
        d = np.exp(e) / np.exp(e).sum(2, keepdims=True)
        np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
        return d, {}

    grads = nn.emissions_grad(p, x, slope)
    for name in ("xf", "hf", "hb", "o"):
        at = (1, 1)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.05, abs=5e-3)


def test_long_texts_are_read_in_windows_alike():
    names, p = langid.train(["the cat and the dog " * 20, "der hund und die katze " * 20], ["en", "de"], steps=30)
    text = "the dog and a cat, der hund " * 60
    whole = np.concatenate([[langid.EDGE], np.frombuffer(text.encode(), np.uint8), [langid.EDGE]]).astype(np.int64)
    one = langid.label_sums(p, [(whole, 1, len(whole) - 1)])[0]
    parts = langid.label_sums(p, list(langid.windows(text.encode()))).sum(0)
    assert sum(z - a for _, a, z in langid.windows(text.encode())) == len(text) and np.allclose(one, parts, rtol=0.02)


def brute_mix(rows):
    """Copies by document: budgets shared by the smallest capacity per weight first, prefixes by sorted keys."""
    docs = []
    for doc, text, lang, source in rows:
        n = len((text or "").split())
        if n:
            domain = "web" if md5((source or "").encode()).hexdigest()[0] < "8" else "curated"
            docs.append((doc, (domain, lang or "", source or ""), n))
    supply = {}
    for _, leaf, n in docs:
        supply[leaf] = supply.get(leaf, 0) + n
    budget = {(): math.floor(sum(supply.values()) * mixing.SHARE)}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in [k for k in budget if len(k) == depth]:
            caps = {}
            for leaf, n in supply.items():
                if leaf[:depth] == parent:
                    caps[leaf[: depth + 1]] = caps.get(leaf[: depth + 1], 0) + n * mixing.MAX_EPOCHS
            weight = {k: mixing.WEIGHTS.get(level, {}).get(k[-1], 1) for k in caps}
            left, open_ = budget[parent], dict(caps)
            for k in sorted(caps, key=lambda c: (caps[c] / weight[c], c[-1])):
                if caps[k] * sum(weight[c] for c in open_) <= left * weight[k]:
                    budget[k] = caps[k]
                    left -= caps[k]
                    del open_[k]
            for k in open_:
                budget[k] = min(caps[k], math.floor(left * weight[k] / sum(weight[c] for c in open_)))
    out = {}
    for leaf, total in supply.items():
        epochs, rest = divmod(budget[leaf], total)
        key = lambda d: md5(f"{mixing.SEED}:{epochs}:{'' if d is None else d}".encode()).hexdigest()
        got, seen = 0, set()
        for doc, n in sorted(((d, n) for d, one, n in docs if one == leaf), key=lambda x: key(x[0])):
            more = doc in seen or got < rest
            seen |= {doc} if more else set()
            got += n
            if epochs + more:
                out[doc] = epochs + more
    return out


def test_mixing_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = {r["doc_id"]: r["copies"] for r in mixing.mixing_query(docs).collect()}
    assert got == brute_mix([tuple(r)[:4] for r in docs.collect()])


def test_headers_and_other_templates(spark):
    def numbered(turns):
        return "<s>" + "".join(f"[{i}:{r}]{t}</{r}>" for i, (r, t) in enumerate(turns))

    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spans = chat.formatted_turns(df, numbered).orderBy("position").collect()
    assert "".join(r["span"] for r in spans) == numbered([(r, t) for _, _, r, t in rows]) and not any(r["rewrites_history"] for r in spans)
    got = chat.format_digests(df, numbered, role_of=lambda span: span[span.index(":") + 1 : span.index("]")], plain=lambda t: t).first()
    assert got["turns_sha256"] == sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest() and got["loss_chars"] == sum(len(t) for _, _, r, t in rows if r == "assistant")
    assert chat.format_digests(df.limit(0)).isEmpty()


def test_clashing_columns_ties_and_null_labels(spark):
    rows = [(1, "das ist ein satz", "de", "x", 1), (1, "das ist ein satz", "de", "x", 1), (2, "this is a line", "en", "x", 2), (None, None, None, "x", None), (3, "1234 !!", "en", "x", 3), (4, "", None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score long")
    got = langid.language_query(df).collect()
    assert len(got) == 6 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (None, 3, 4))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    scored = quality.score_quality(df, quality.fit_quality(df, labels)).collect()
    assert len(scored) == 6 and all(0 <= r["score"] <= 1 for r in scored)
    marks = fingerprint.fingerprint_neighbours(df).collect()
    assert len(marks) == 6 and len({r["fingerprint"] for r in marks if r["doc_id"] == 1}) == 1
    assert quality.score_quality(df.limit(0), quality.fit_quality(df.limit(0), labels)).isEmpty()
    assert decontam.contaminated(df.limit(0), spark.createDataFrame([(1, "a passage of some length here")], "item_id long, text string")).isEmpty()


def test_stages_take_odd_and_empty_documents(spark):
    rows = [(None, "a lone text without an id", None, None, 25), (1, None, None, "src0", None), (2, "", "en", None, 0), (4, "same words here again", "en", "src1", 21), (4, "same words here again", "en", "src1", 21), (5, "long " * 20_000, "de", "src0", 100_000)]
    odd = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert 0 <= out.count() <= len(rows), name
        assert stage(spark, odd.limit(0), SF).isEmpty(), name
