"""DuckDB SQL of the catalogue's queries, written apart from their plans."""

from __future__ import annotations

from .bindings import WORDS


def words(*kinds: str) -> str:
    return ", ".join(f"'{w}'" for k in kinds for w in WORDS[k])


SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for k, ws in WORDS.items() for w in ws) + ") s(term, polarity))"
TOK = r"""
docs AS (SELECT doc_id, text FROM documents),
sents AS (SELECT doc_id, CAST(g.i - 1 AS INT) AS sent_id, ss[g.i] AS s FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.\n]') AS ss FROM docs) x, unnest(generate_series(1, len(ss))) g(i)),
forms AS (SELECT doc_id, sent_id, CAST(g.i - 1 AS INT) AS pos, fs[g.i] AS form FROM (SELECT doc_id, sent_id, regexp_extract_all(s, '\p{L}+') AS fs FROM sents) x, unnest(generate_series(1, len(fs))) g(i)),
tok AS (SELECT *, replace(lower(form), 'ß', 'ss') AS lemma, CASE WHEN substr(form, 1, 1) <> lower(substr(form, 1, 1)) THEN 'NN' WHEN form LIKE '%n' THEN 'VV' WHEN length(form) > 4 THEN 'ADJD' ELSE 'KON' END AS tag FROM forms),
kept AS (SELECT * FROM tok WHERE tag <> 'KON' AND regexp_matches(lemma, '^[-#.,A-Za-z0-9_]+$'))"""
T = f"WITH {TOK}"
NET = """
li AS (SELECT DISTINCT l_orderkey AS synid, l_partkey AS pk FROM lineitem),
m AS (SELECT synid, CASE synid % 3 WHEN 0 THEN 'adj' WHEN 1 THEN 'nomen' ELSE 'verben' END AS pos, pk, p_name || ' ' || p_brand AS form FROM li JOIN part ON pk = p_partkey),
con AS (SELECT * FROM (SELECT o_orderkey AS f, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders) WHERE t IS NOT NULL),
lex AS (SELECT synid, min(pk) AS a, max(pk) AS b FROM m GROUP BY synid HAVING min(pk) < max(pk)),
terms AS (SELECT DISTINCT form, pos FROM m),
nseeds AS (SELECT term, min(k) AS k FROM (SELECT p_name || ' ' || p_brand AS term, CASE WHEN p_partkey % 97 = 0 THEN 0 WHEN p_partkey % 101 = 1 THEN 1 WHEN p_partkey % 103 = 2 THEN 2 END AS k FROM part) WHERE k IS NOT NULL GROUP BY term),
seeds AS (SELECT term, k, CASE k WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS polarity FROM nseeds),
nodes AS (SELECT form, pos, polarity, k FROM terms JOIN seeds ON term = form)"""
N = f"WITH {NET}"
GRAPH = """
pairs AS (
  SELECT a.form AS src, a.pos AS src_pos, b.form AS dst, b.pos AS dst_pos FROM m a JOIN m b ON a.synid = b.synid
  UNION ALL SELECT a.form, a.pos, b.form, b.pos FROM m a JOIN con ON f = a.synid JOIN m b ON b.synid = t),
graph AS (SELECT src, src_pos, dst, dst_pos, count(*) AS w FROM pairs WHERE src <> dst OR src_pos <> dst_pos GROUP BY ALL),
trans AS (SELECT *, w / sum(w) OVER (PARTITION BY src, src_pos) AS p FROM graph)"""
CELLS = """
raw AS (
  SELECT a.form AS i, a.pos AS i_pos, b.form AS j, b.pos AS j_pos, 0.2 AS w, 2 AS rank FROM m a JOIN m b ON a.synid = b.synid
  UNION ALL SELECT x.form, x.pos, y.form, y.pos, -0.2, 1 FROM lex JOIN m x ON x.synid = lex.synid AND x.pk = lex.b JOIN m y ON y.synid = lex.synid AND y.pk = lex.a
  UNION ALL SELECT x.form, x.pos, y.form, y.pos, 0.2, 3 FROM con JOIN m x ON x.synid = t JOIN m y ON y.synid = f),
cells AS (
  SELECT i, i_pos, j, j_pos, CAST(w AS DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY i, i_pos, j, j_pos ORDER BY rank DESC, w) AS r FROM raw WHERE i <> j OR i_pos <> j_pos) WHERE r = 1
  UNION ALL SELECT form, pos, form, pos, 1.2 FROM terms)"""


def matvec(rounds: int) -> str:
    held = lambda x: f"CASE polarity WHEN 'positive' THEN greatest({x}, 1) WHEN 'negative' THEN least({x}, -1) WHEN 'neutral' THEN 0 ELSE {x} END"
    out = [f"v0 AS (SELECT form, pos, CAST({held('0')} AS DOUBLE) AS x FROM nodes)"]
    for k in range(1, rounds + 1):
        out.append(f"m{k} AS MATERIALIZED (SELECT i AS form, i_pos AS pos, sum(w * x) AS x FROM cells JOIN v{k - 1} ON j = form AND j_pos = pos GROUP BY ALL)")
        out.append(f"v{k} AS MATERIALIZED (SELECT form, pos, {held('coalesce(x, 0)')} AS x FROM m{k} FULL JOIN nodes USING (form, pos))")
    return ", ".join(out)


def label_prop(rounds: int) -> str:
    hot = [f"CASE WHEN polarity = '{k}' THEN 1.0 ELSE 0.0 END" for k in ("positive", "negative", "neutral")]
    first = ", ".join(f"CAST(CASE WHEN polarity IS NULL THEN {int(k == 2)} ELSE {h} END AS DOUBLE) AS y{k}" for k, h in enumerate(hot))
    out = ["norm AS MATERIALIZED (SELECT i, i_pos, j, j_pos, w / sum(w) OVER (PARTITION BY j, j_pos) AS w FROM cells WHERE w > 0)", f"y_0 AS (SELECT form, pos, {first} FROM terms LEFT JOIN nodes USING (form, pos))"]
    for r in range(1, rounds + 1):
        sums = ", ".join(f"sum(w * y{k}) AS y{k}" for k in range(3))
        pins = ", ".join(f"CAST(CASE WHEN polarity IS NULL THEN y{k} ELSE {h} END AS DOUBLE) AS y{k}" for k, h in enumerate(hot))
        out.append(f"z_{r} AS (SELECT i AS form, i_pos AS pos, {sums} FROM norm JOIN y_{r - 1} ON j = form AND j_pos = pos GROUP BY ALL)")
        out.append(f"p_{r} AS (SELECT form, pos, {pins} FROM z_{r} LEFT JOIN nodes USING (form, pos))")
        total = "CASE WHEN y0 + y1 + y2 = 0 THEN 1 ELSE y0 + y1 + y2 END"
        out.append(f"y_{r} AS MATERIALIZED (SELECT form, pos, " + ", ".join(f"y{k} / {total} AS y{k}" for k in range(3)) + f" FROM p_{r})")
    return ", ".join(out)


def walk(steps: int) -> str:
    out = ["pin AS (SELECT form, pos, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS x FROM nodes)", "open AS MATERIALIZED (SELECT * FROM trans t WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.form = t.src AND n.pos = t.src_pos))", "w0 AS (SELECT * FROM pin)"]
    for k in range(1, steps + 1):
        out.append(f"w{k} AS MATERIALIZED (SELECT src AS form, src_pos AS pos, sum(p * x) AS x FROM open JOIN w{k - 1} ON dst = form AND dst_pos = pos GROUP BY ALL UNION ALL SELECT * FROM pin)")
    return ", ".join(out)


def best_by_form(rows: str, digits: int) -> str:
    return f"SELECT form AS term, polarity, round(score, {digits}) AS score FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY abs(score) DESC, polarity, pos) AS r FROM ({rows})) WHERE r = 1"


PMI = f"""{SEEDS}, {TOK},
w AS (SELECT DISTINCT doc_id, lemma AS term FROM kept),
msg AS (SELECT doc_id, min(CASE polarity WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END) AS c FROM w JOIN seeds USING (term) GROUP BY doc_id),
tot AS (SELECT count(*) FILTER (WHERE c = 0) AS np, count(*) FILTER (WHERE c = 1) AS nn, count(*) FILTER (WHERE c = 2) AS nu FROM msg),
st AS (SELECT term, count(*) FILTER (WHERE c = 0) AS p, count(*) FILTER (WHERE c = 1) AS n, count(*) FILTER (WHERE c = 2) AS u FROM w JOIN msg USING (doc_id) GROUP BY term HAVING count(*) >= 4),
sc AS (SELECT term, log2(coalesce(nullif((p + n) * nu / coalesce(nullif(u * (np + nn), 0), 1), 0), 1)) AS subj, log2(coalesce(nullif(p * nn / coalesce(nullif(n * np, 0), 1), 0), 1)) AS pol FROM st, tot WHERE term NOT IN (SELECT term FROM seeds)),
pmi AS (SELECT term, CASE WHEN pol > 0 THEN 'positive' ELSE 'negative' END AS polarity, round(pol + subj, 6) AS score FROM sc WHERE subj > 0)"""
SURE = "SELECT term, polarity, CASE polarity WHEN 'positive' THEN 1.7976931348623157e308 ELSE -1.7976931348623157e308 END::DOUBLE AS score FROM seeds WHERE polarity <> 'neutral'"


def top_words(lang: str) -> str:
    t = TOK.replace("FROM documents)", f"FROM documents WHERE lang = '{lang}')")
    return f"(WITH {t} SELECT lemma AS term, CASE WHEN count(*) % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity, CAST(count(*) AS DOUBLE) AS score FROM kept GROUP BY lemma ORDER BY count(*) DESC, lemma LIMIT 200)"


EVAL = f"""
lexi AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{k}')" for k in ("positive", "negative") for w in WORDS[k])}, ('the thing', 'positive'), ('of ering', 'negative')) x(s, class)),
alt AS (SELECT DISTINCT doc_id, sent_id, pos, w FROM (SELECT doc_id, sent_id, pos, lower(form) AS w FROM tok UNION ALL SELECT doc_id, sent_id, pos, lemma FROM tok)),
hits AS (
  SELECT DISTINCT doc_id, sent_id, pos AS "start", pos AS "end", class FROM alt JOIN lexi ON w = s
  UNION SELECT DISTINCT a.doc_id, a.sent_id, a.pos, b.pos, class FROM alt a JOIN alt b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos = a.pos + 1 JOIN lexi ON s = a.w || ' ' || b.w),
gold AS (SELECT DISTINCT doc_id, sent_id, pos AS "start", pos AS "end", CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS class FROM tok JOIN labels USING (doc_id) WHERE (quality = 1 OR toxic = 1) AND lemma IN ({words("positive", "negative")})),
at_h AS (SELECT DISTINCT doc_id, sent_id, "end" AS pos FROM hits), at_g AS (SELECT DISTINCT doc_id, sent_id, "end" AS pos FROM gold),
ev AS (
  SELECT doc_id, class, CASE WHEN g.doc_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN g.doc_id IS NULL THEN 1 ELSE 0 END AS fp, 0 AS fn FROM hits h LEFT JOIN gold g USING (doc_id, sent_id, "start", "end", class)
  UNION ALL SELECT doc_id, class, 0, 0, 1 FROM gold ANTI JOIN hits USING (doc_id, sent_id, "start", "end", class)
  UNION ALL SELECT doc_id, 'neutral', 0, 0, 1 FROM (SELECT * FROM hits ANTI JOIN gold USING (doc_id, sent_id, "start", "end", class)) WHERE "start" <> "end"
  UNION ALL SELECT doc_id, 'neutral', CASE WHEN h.pos IS NULL AND g.pos IS NULL THEN 1 ELSE 0 END, CASE WHEN h.pos IS NULL AND g.pos IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN h.pos IS NOT NULL AND g.pos IS NULL THEN 1 ELSE 0 END
    FROM tok LEFT JOIN at_h h USING (doc_id, sent_id, pos) LEFT JOIN at_g g USING (doc_id, sent_id, pos)),
ta AS (SELECT doc_id, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ev GROUP BY ALL HAVING sum(tp) + sum(fp) + sum(fn) > 0)"""


def prf(by: str) -> str:
    p, r = "CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp > 0 THEN tp / (tp + fn) ELSE 0 END"
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return (
        f"SELECT {head}avg({p}) AS macro_p, avg({r}) AS macro_r, avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro_f1, "
        f"coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0) AS micro_p, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0) AS micro_r, coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS micro_f1 FROM "
    ), f" {group}"


SCORES = ("macro_p", "macro_r", "macro_f1", "micro_p", "micro_r", "micro_f1")
R6 = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)


def agreement(scheme: str) -> str:
    ann = lambda k: f"a{k} AS (SELECT DISTINCT doc_id, class, place AS lo, place + (pos + {k}) % 2 AS hi FROM (SELECT doc_id, pos, sent_id * 100000 + pos AS place, CASE WHEN lemma IN ({words('positive')}) THEN 'positive' WHEN lemma IN ({words('negative')}) THEN 'negative' END AS class FROM tok) WHERE class IS NOT NULL AND pos % {7 if k == 1 else 5} <> 0)"
    shared = {"binary": "CASE WHEN c > 0 THEN hi - lo + 1 ELSE 0 END", "proportional": "c", "exact": "CASE WHEN e > 0 THEN hi - lo + 1 ELSE 0 END"}[scheme]
    ids = lambda k: f"i{k} AS (SELECT DISTINCT doc_id, class, unnest(generate_series(lo, hi)) AS id FROM a{k})"
    side = lambda k, o: (
        f"s{k} AS (SELECT class, sum(hi - lo + 1) AS t, sum({shared}) AS o FROM (SELECT a.*, (SELECT count(*) FROM i{o} i WHERE i.doc_id = a.doc_id AND i.class = a.class AND i.id BETWEEN a.lo AND a.hi) AS c, "
        f"(SELECT count(*) FROM a{o} b WHERE b.doc_id = a.doc_id AND b.class = a.class AND b.lo = a.lo AND b.hi = a.hi) AS e FROM a{k} a) GROUP BY class)"
    )
    return f"""{T}, {ann(1)}, {ann(2)}, {ids(1)}, {ids(2)}, {side(1, 2)}, {side(2, 1)},
x AS (SELECT class, CAST(coalesce(s1.t, 0) AS BIGINT) AS t1, CAST(coalesce(s1.o, 0) AS BIGINT) AS o1, CAST(coalesce(s2.t, 0) AS BIGINT) AS t2, CAST(coalesce(s2.o, 0) AS BIGINT) AS o2, (SELECT count(*) FROM tok)::DOUBLE AS n FROM s1 FULL JOIN s2 USING (class)),
y AS (SELECT *, (n - t1 + o1 - t2 + o2) / n AS seen, t1 / n * (t2 / n) + (1 - t1 / n) * (1 - t2 / n) AS chance FROM x)
SELECT class, t1, o1, t2, o2, round(CASE WHEN chance < 1 THEN (seen - chance) / (1 - chance) ELSE 0 END, 6) AS kappa FROM y"""


CLASS = "CASE WHEN label <= 3 THEN 'positive' WHEN label <= 6 THEN 'negative' ELSE 'neutral' END"
VEC = f"e AS (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(generate_series(0, len(embedding) - 1))::INT AS i, {CLASS} AS c FROM embeddings)"
SPANS = "u AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM u), r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_orderkey, k)"
LABEL = lambda kind: f"len(list_filter(ws, lambda x: x IN ({words(kind)}))) > 0"

ORACLE = {
    "normalize_tokens": f"{T} SELECT lemma, count(*) AS n FROM tok GROUP BY lemma",
    "check_word_filter": f"{T} SELECT doc_id, count(*) AS n FROM tok WHERE regexp_matches(lemma, '^[-#.,A-Za-z0-9_]+$') GROUP BY doc_id",
    "tag_filter": f"{T} SELECT doc_id, tag, count(*) AS n FROM kept GROUP BY doc_id, tag",
    "form2lemma_join": f"{T} SELECT CASE WHEN form LIKE '%s' THEN substr(lemma, 1, length(lemma) - 1) ELSE lemma END AS lemma, count(*) AS n FROM tok GROUP BY 1",
    "stopword_prune": f"{T} SELECT doc_id, count(*) AS n FROM tok WHERE form NOT IN (SELECT form FROM tok GROUP BY form HAVING count(*) >= 500) GROUP BY doc_id",
    "message_sessionise": "SELECT conv_id, unit, count(*) AS n FROM (SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit FROM conversations) GROUP BY conv_id, unit",
    "word_count_min4": f"{T} SELECT lemma, count(*) AS n, count(DISTINCT doc_id) AS df FROM kept GROUP BY lemma HAVING count(*) >= 4",
    "bigrams": f"{T} SELECT prev, lemma, count(*) AS n FROM (SELECT lemma, lag(lemma) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS prev FROM kept) WHERE prev IS NOT NULL GROUP BY ALL",
    "feature_df": f"{T}, two AS (SELECT doc_id, lemma, lag(lemma) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS prev FROM kept), f AS (SELECT doc_id, lemma AS feature FROM two UNION SELECT doc_id, prev || ' ' || lemma FROM two WHERE prev IS NOT NULL) SELECT feature, count(*) AS df FROM f GROUP BY feature HAVING count(*) >= 4",
    "context_pairs": f"{T}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS r FROM kept) SELECT x.lemma AS a, y.lemma AS b, count(*) AS n FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND x.r BETWEEN y.r - 5 AND y.r - 1 GROUP BY ALL HAVING count(*) >= 2",
    "cooc_symmetric": f"{T}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS r FROM kept), often AS (SELECT lemma FROM kept GROUP BY lemma HAVING count(*) >= 4), cp AS (SELECT x.lemma AS a, y.lemma AS b, count(*) AS n FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND x.r BETWEEN y.r - 5 AND y.r - 1 GROUP BY ALL HAVING count(*) >= 4), s AS (SELECT * FROM cp WHERE a IN (FROM often) AND b IN (FROM often)) SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM s UNION ALL SELECT b, a, n FROM s) GROUP BY a, b",
    "negation_scope": f"{T} SELECT doc_id, CAST(sum(CASE WHEN hit THEN -1 ELSE 1 END) AS BIGINT) AS weight FROM (SELECT doc_id, coalesce(bool_or(lemma IN ('nicht', 'not', 'pas', 'no')) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM tok) GROUP BY doc_id",
    "label_lines": f"SELECT doc_id, CASE WHEN {LABEL('positive')} THEN '1' WHEN {LABEL('negative')} THEN '2' WHEN {LABEL('neutral')} THEN '0' ELSE '_' END AS label FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+'), lambda x: replace(lower(x), 'ß', 'ss')) AS ws FROM documents)",
    "gloss_tfidf": f"{T}, tf AS (SELECT doc_id, lemma, count(*) AS tf FROM kept GROUP BY ALL), df AS (SELECT lemma, count(*) AS df FROM tf GROUP BY lemma), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), raw AS (SELECT doc_id, lemma, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (lemma), n) SELECT doc_id, lemma, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM raw",
    "lexicon_pmi": f"WITH {PMI} SELECT * FROM pmi UNION ALL {SURE}",
    "lexicon_default": f"WITH {SEEDS} SELECT term, polarity, CASE polarity WHEN 'positive' THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM seeds WHERE polarity <> 'neutral'",
    "lexicon_topn": f"WITH {PMI} SELECT * FROM pmi ORDER BY abs(score) DESC, term LIMIT 100",
    "cardinality_sweep": f"WITH {PMI}, rk AS (SELECT *, row_number() OVER (ORDER BY abs(score) DESC, term) AS r FROM pmi) SELECT CAST(s AS INT) AS size, polarity, count(*) AS n FROM rk JOIN (SELECT unnest([40, 60, 80, 100, 120, 140, 160]) AS s) ON r <= s GROUP BY ALL",
    "lexicon_union": " UNION ".join(f"SELECT term, polarity FROM {top_words(k)}" for k in ("en", "de", "fr")),
    "lexicon_intersect": " INTERSECT ".join(f"SELECT term, polarity FROM {top_words(k)}" for k in ("en", "de")),
    "lexicon_argmax_abs": best_by_form(" UNION ALL ".join(f"SELECT term AS form, '{k}' AS pos, polarity, score FROM {top_words(k)}" for k in ("en", "de", "fr")), 6),
    "net_terms": f"{N} SELECT * FROM terms",
    "seed_nodes": f"{N} SELECT form, pos, polarity FROM nodes",
    "seed_synsets": f"{N} SELECT DISTINCT synid, polarity FROM m JOIN seeds ON term = form",
    "seed_cross_pos": f"{N} SELECT term, unnest(['adj', 'nomen', 'verben']) AS pos, polarity FROM seeds",
    "term_graph": f"{N}, {GRAPH} SELECT * FROM graph",
    "transition_prob": f"{N}, {GRAPH} SELECT src, src_pos, dst, dst_pos, round(p, 6) AS p, round(sum(p) OVER (PARTITION BY src, src_pos ORDER BY dst, dst_pos ROWS UNBOUNDED PRECEDING), 6) AS cum_p FROM trans",
    "mean_degree": f"{N}, {GRAPH} SELECT round(avg(d), 6) AS mean_degree FROM (SELECT count(*) AS d FROM graph GROUP BY src, src_pos)",
    "signed_matrix": f"{N}, {CELLS} SELECT * FROM cells",
    "reachability": f"WITH RECURSIVE {NET}, first AS (SELECT f AS node FROM con WHERE f NOT IN (SELECT t FROM con)), reach AS (SELECT node, 0 AS depth FROM first UNION SELECT t, depth + 1 FROM reach JOIN con ON f = node WHERE depth < 6) SELECT node, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY node",
    "reachability_all": f"WITH RECURSIVE {NET}, first AS (SELECT f AS node FROM con WHERE f NOT IN (SELECT t FROM con)), reach AS (SELECT node, 0 AS depth FROM first UNION SELECT t, depth + 1 FROM reach JOIN con ON f = node) SELECT node, CAST(min(depth) AS INT) AS depth FROM reach GROUP BY node",
    "lexicon_matvec": f"{N}, {CELLS}, {matvec(5)}, ends AS (SELECT max(x) AS hi, min(x) AS lo FROM v5), "
    f"fin AS (SELECT form, pos, CASE polarity WHEN 'positive' THEN hi + 1 WHEN 'negative' THEN lo - 1 ELSE x END AS score FROM v5 LEFT JOIN nodes USING (form, pos), ends) {best_by_form('SELECT form, pos, CASE WHEN score > 0 THEN $$positive$$ ELSE $$negative$$ END AS polarity, score FROM fin WHERE abs(score) >= 0.5', 4)}",
    "lexicon_label_prop": f"{N}, {CELLS}, {label_prop(4)} "
    + best_by_form("SELECT form, pos, polarity, CASE polarity WHEN 'positive' THEN y0 ELSE y1 END AS score FROM (SELECT *, CASE WHEN round(y0, 9) >= round(y1, 9) AND round(y0, 9) >= round(y2, 9) THEN 'positive' WHEN round(y1, 9) >= round(y2, 9) THEN 'negative' END AS polarity FROM y_4) WHERE polarity IS NOT NULL", 6),
    "lexicon_random_walk": f"{N}, {GRAPH}, {walk(4)} " + best_by_form("SELECT form, pos, CASE WHEN x > 0 THEN 'positive' ELSE 'negative' END AS polarity, x AS score FROM w4 WHERE abs(x) > 0.02", 6),
    "lexicon_bayes": f"""{N}, syn AS (SELECT DISTINCT synid, polarity FROM m JOIN seeds ON term = form), fac AS (SELECT polarity, count(*) / (SELECT count(*) FROM terms) / (SELECT count(*) FROM syn s WHERE s.polarity = n.polarity) AS f FROM nodes n GROUP BY polarity),
h AS (SELECT form, pos, polarity, count(*) AS hits FROM (SELECT DISTINCT synid, form, pos FROM m) JOIN syn USING (synid) GROUP BY ALL), s AS (SELECT form, pos, polarity, hits * f AS score FROM h JOIN fac USING (polarity)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form, pos ORDER BY round(score, 15) DESC, CASE polarity WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END) AS q FROM s) WHERE q = 1)
{best_by_form("SELECT form, pos, polarity, score FROM b WHERE polarity <> 'neutral' AND form NOT IN (SELECT term FROM seeds WHERE polarity <> 'neutral')", 12)} UNION ALL {SURE}""",
    "vec_length_norm": f"WITH {VEC} SELECT id, i, round(coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0), x), 6) AS x FROM e",
    "vec_zscore": f"WITH {VEC} SELECT id, i, round(coalesce((x - avg(x) OVER (PARTITION BY i)) / nullif(stddev_samp(x) OVER (PARTITION BY i), 0), 0), 6) AS x FROM e",
    "centroids": f"WITH {VEC} SELECT c AS polarity, i, round(avg(x), 6) AS x FROM e GROUP BY c, i",
    "pairwise_distance": f"WITH {VEC} SELECT a.id, b.id AS seed, round(sum((a.x - b.x) * (a.x - b.x)), 5) AS d FROM e a JOIN e b USING (i) WHERE b.id % 10 = 0 GROUP BY a.id, b.id",
    "lexicon_nearest_centroid": f"WITH {VEC}, ce AS (SELECT c, i, avg(x) AS x FROM e WHERE id % 10 = 0 GROUP BY c, i), di AS (SELECT e.id, ce.c, sqrt(sum((e.x - ce.x) * (e.x - ce.x))) AS d FROM e JOIN ce USING (i) GROUP BY e.id, ce.c), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), CASE c WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END) AS r FROM di) SELECT id, c AS polarity, round(d, 6) AS score FROM o WHERE r = 1 AND c <> 'neutral' AND id % 10 <> 0",
    "lexicon_knn": f"WITH {VEC}, di AS (SELECT a.id, b.id AS sid, b.c, sum((a.x - b.x) * (a.x - b.x)) AS d FROM e a JOIN e b USING (i) WHERE b.id % 10 = 0 AND a.id % 10 <> 0 GROUP BY a.id, b.id, b.c), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), sid) AS r FROM di), s AS (SELECT id, c, sum(d) / (count(*) * count(*)) AS score FROM k WHERE r <= 5 GROUP BY id, c), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9), CASE c WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END) AS q FROM s) SELECT id, c AS polarity, round(score, 6) AS score FROM o WHERE q = 1 AND c <> 'neutral'",
    "lexicon_match": f'{T}, {EVAL} SELECT doc_id, sent_id, "start", "end", class FROM hits',
    "eval_tally": f"{T}, {EVAL} SELECT * FROM ta",
    "eval_prf_file": f"{T}, {EVAL} SELECT doc_id, {R6} FROM ({'ta'.join(prf('doc_id'))})",
    "eval_prf_spread": f"{T}, {EVAL} SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in SCORES) + f" FROM ({'ta'.join(prf('doc_id'))})",
    "eval_prf_pooled": f"{T}, {EVAL} SELECT {R6} FROM ({'(SELECT class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ta GROUP BY class)'.join(prf(''))})",
    "corpus_diff": f"{T}, {EVAL} SELECT *, 'missing' AS kind FROM (FROM hits EXCEPT FROM gold) UNION ALL SELECT *, 'redundant' FROM (FROM gold EXCEPT FROM hits)",
    **{f"agreement_{k}": agreement(k) for k in ("binary", "proportional", "exact")},
    "ids_to_span": f"WITH {SPANS} SELECT l_orderkey, string_agg('word_' || a || CASE WHEN b > a THEN '..word_' || b ELSE '' END, ',' ORDER BY a) AS span FROM r GROUP BY l_orderkey",
    "span_to_ids": "SELECT DISTINCT l_orderkey, CAST(l_linenumber AS INT) AS id FROM lineitem",
    "lookup_default": "SELECT o_orderkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS class FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "anti_enrich": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "positional_zip": "SELECT * FROM (SELECT s_nationkey AS nation, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS r, s_suppkey FROM supplier) JOIN (SELECT c_nationkey AS nation, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS r, c_custkey FROM customer) USING (nation, r)",
    "sample_vectors": "SELECT vec_id, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings WHERE vec_id % 10 <> 0 ORDER BY h, vec_id LIMIT 100",
}
