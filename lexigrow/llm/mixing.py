"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of domain, language and source.  At each node it
is shared by weight among the children; a child that cannot take its share (its
supply times ``MAX_EPOCHS``) takes what it can, and its shortage goes to its
siblings first.  Since a node's own capacity is the sum of its leaves', only
what the siblings cannot take is left to the node's siblings in turn.

A leaf with quota Q and supply S takes floor(Q / S) whole epochs and, of the
next epoch's seeded order, the shortest prefix whose tokens reach the rest.  The
prefix is found with two-level running sums, so that a hot leaf is spread over
4,096 hash ranges, and comes back as one cutoff key per leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, materialize

MAX_EPOCHS = 3
SEED = "mix-1"
#: The budget as a share of all tokens.
SHARE = 0.5
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"curated": 3, "web": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}

#: Spark and DuckDB both run these; ``{TOKENS}`` differs, as their regular expressions do.
BASE_SQL = """
SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN substr(md5({SOURCE}), 1, 1) < '8' THEN 'web' ELSE 'curated' END AS domain,
  CAST({TOKENS} AS BIGINT) AS n_tokens
FROM documents"""
SPARK_TOKENS = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w'), '[\\x20\\x09-\\x0D]+', ''))"
DUCK_TOKENS = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g'))"


def weight_sql(level: str, weights: dict[str, dict[str, int]]) -> str:
    cases = "".join(f" WHEN '{k}' THEN {w}" for k, w in weights.get(level, {}).items())
    return f"CASE {level}{cases} ELSE 1 END" if cases else "1"


def share_ctes(weights: dict[str, dict[str, int]], share: float, epochs: int) -> str:
    """CTEs from ``leaf_supply`` to ``quota``: the budget of every leaf."""
    out, above = [], []
    for depth, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: depth + 1])
        part = f"PARTITION BY {', '.join(above)} " if above else ""
        parent = f"JOIN b{depth} p USING ({', '.join(above)})" if above else "CROSS JOIN b0 p"  # b0 is one row
        order = f"{part}ORDER BY cap * 1.0 / w, {level}"
        out.append(f"c{depth + 1} AS (SELECT {keys}, CAST(sum(supply) * {epochs} AS BIGINT) AS cap, CAST({weight_sql(level, weights)} AS BIGINT) AS w FROM leaf_supply GROUP BY {keys})")
        out.append(f"d{depth + 1} AS (SELECT c.*, p.budget AS above, sum(cap) OVER ({order}) - cap AS caps_before, sum(w) OVER ({part or ''}) - sum(w) OVER ({order}) + w AS weights_on FROM c{depth + 1} c {parent})")
        out.append(f"e{depth + 1} AS (SELECT d.*, cap * weights_on <= (above - caps_before) * w AS full_up FROM d{depth + 1} d)")
        rest = f"({part.strip()})"
        out.append(
            f"b{depth + 1} AS (SELECT {keys}, CAST(CASE WHEN full_up THEN cap ELSE least(cap, floor((above - spent) * 1.0 * w / open_w)) END AS BIGINT) AS budget "
            f"FROM (SELECT e.*, sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER {rest} AS spent, sum(CASE WHEN full_up THEN 0 ELSE w END) OVER {rest} AS open_w FROM e{depth + 1} e) x)"
        )
        above.append(level)
    return f"b0 AS (SELECT CAST(floor(coalesce(sum(supply), 0) * {share}) AS BIGINT) AS budget FROM leaf_supply),\n" + ",\n".join(out)


#: From ``keyed`` (rows with sort key ``k`` and bucket ``g``) to ``cutoff``: the last key of each leaf's prefix.
PREFIX_CTES = """
ranges AS (SELECT domain, lang, source, g, sum(n_tokens) AS t FROM keyed GROUP BY domain, lang, source, g),
starts AS (SELECT domain, lang, source, g, sum(t) OVER (PARTITION BY domain, lang, source ORDER BY g) - t AS before_range FROM ranges),
sums AS (
  SELECT keyed.*, sum(n_tokens) OVER (PARTITION BY domain, lang, source, g ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(n_tokens) OVER (PARTITION BY domain, lang, source, g, k) AS before_key FROM keyed),
cutoff AS (
  SELECT domain, lang, source, max(k) AS last_k FROM sums JOIN starts USING (domain, lang, source, g)
  WHERE before_range + before_key < rest GROUP BY domain, lang, source)"""

KEYED = """keyed AS (
  SELECT s.domain, s.lang, s.source, n_tokens, rest, {KEY} AS k, substr({KEY}, 1, 3) AS g
  FROM base s JOIN plan USING (domain, lang, source) WHERE n_tokens > 0)"""
KEY = "md5(concat('{seed}:', CAST(epochs AS VARCHAR(20)), ':', coalesce(CAST(doc_id AS VARCHAR(20)), '')))"
PLAN = """plan AS (
  SELECT domain, lang, source, supply, budget, CAST(floor(budget * 1.0 / supply) AS BIGINT) AS epochs,
    budget - CAST(floor(budget * 1.0 / supply) AS BIGINT) * supply AS rest
  FROM leaf_supply JOIN b3 USING (domain, lang, source))"""
LEAF_SUPPLY = "leaf_supply AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM base GROUP BY domain, lang, source HAVING sum(n_tokens) > 0)"


def mixing_sql(weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    key = KEY.format(seed=seed)
    base = BASE_SQL.format(TOKENS=DUCK_TOKENS, SOURCE="coalesce(source, '')")
    return f"""WITH base AS ({base}), {LEAF_SUPPLY}, {share_ctes(weights, share, epochs)}, {PLAN}, {KEYED.format(KEY=key)}, {PREFIX_CTES}
SELECT doc_id, domain, lang, source, n_tokens, epochs + CASE WHEN {key} <= last_k THEN 1 ELSE 0 END AS copies
FROM base JOIN plan USING (domain, lang, source) LEFT JOIN cutoff USING (domain, lang, source)
WHERE n_tokens > 0 AND epochs + CASE WHEN {key} <= last_k THEN 1 ELSE 0 END > 0"""


#: Leaves up to this many are broadcast to the texts; more are joined by shuffle.
BROADCAST_LEAVES = 20_000


def mixed(df: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows of ``df`` with domain, n_tokens and copies (at least 1), for the mix of target ``weights``.

    ``copies`` says how often a document is seen: once per whole epoch of its
    leaf, once more if it is in the last epoch's prefix.  Null languages and
    sources are leaves of their own, named ``''``; texts without words are never
    chosen; rows of a repeated id stand or fall together, as they share a key.
    A budget over all capacities is cut to them; a share rounds down.
    """
    spark: SparkSession = df.sparkSession
    base = spark.sql(BASE_SQL.format(TOKENS=SPARK_TOKENS, SOURCE="CAST(coalesce(source, '') AS BINARY)").replace("FROM documents", "FROM {docs}"), docs=df.select("doc_id", "text", "lang", "source"))
    base = materialize(base)
    key = KEY.format(seed=seed).replace("VARCHAR(20)", "STRING")
    key = key.replace("md5(concat(", "md5(CAST(concat(")[:-1] + " AS BINARY))"
    plan = materialize(spark.sql(f"WITH {LEAF_SUPPLY.replace('FROM base', 'FROM {base}')}, {share_ctes(weights, share, epochs)}, {PLAN} SELECT * FROM plan", base=base))
    keyed = KEYED.format(KEY=key)
    few = plan.count() <= BROADCAST_LEAVES
    # the leaves go to the rows, so that only (leaf, hash range) deals the rows out
    keyed = keyed.replace("SELECT s.domain", "SELECT /*+ BROADCAST(p) */ s.domain" if few else "SELECT s.domain")
    cut = spark.sql(f"WITH {keyed.replace('FROM base', 'FROM {base}').replace('JOIN plan', 'JOIN {plan} p')}, {PREFIX_CTES} SELECT * FROM cutoff", base=base, plan=plan)
    leaves = materialize(plan.join(cut, list(LEVELS), "left").selectExpr("domain AS _d", "lang AS _l", "source AS _s", "epochs", "last_k"))
    side = leaves.hint("broadcast") if few else leaves
    texts = spark.sql(
        "SELECT *, CASE WHEN substr(md5(CAST(coalesce(source, '') AS BINARY)), 1, 1) < '8' THEN 'web' ELSE 'curated' END AS domain, CAST(" + SPARK_TOKENS + " AS BIGINT) AS n_tokens FROM {docs}",
        docs=df.select(*[c for c in DOCUMENT_COLUMNS if c in df.columns]),
    )
    named = texts.selectExpr("*", "domain AS _d", "coalesce(lang, '') AS _l", "coalesce(source, '') AS _s")
    out = named.where("n_tokens > 0").join(side, ["_d", "_l", "_s"])
    copies = f"epochs + CASE WHEN {key} <= last_k THEN 1 ELSE 0 END"
    return out.withColumn("copies", F.expr(copies)).where("copies > 0").drop("_d", "_l", "_s", "epochs", "last_k")


def mixing_query(df: DataFrame) -> DataFrame:
    """Without the texts; nulls in lang and source show as ``''``, as the leaves are named."""
    return mixed(df).selectExpr("doc_id", "domain", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "n_tokens", "copies")


def mixing_stage(df: DataFrame) -> DataFrame:
    """The mix: ``documents`` with domain, n_tokens and copies; rows without words are in no mix, repeated rows stand or fall together."""
    return mixed(df)
