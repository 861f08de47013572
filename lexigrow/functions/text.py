"""String and span functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFORMATIVE = ("AD", "FM", "NE", "NN", "VV")


def normalize(c: Column) -> Column:
    """Lower case, blanks squeezed, sharp s spelled out, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?:\t| \s)+", " "), "ß", "ss"))


def normalize_string(c: Column, ignore_case: bool = True) -> Column:
    """Hash, comma and full stop deleted, blank runs squeezed, trimmed."""
    out = F.trim(F.regexp_replace(F.translate(c, "#,.", ""), r"\s{2,}", " "))
    return F.lower(out) if ignore_case else out


def check_word(c: Column, unicode_words: bool = False) -> Column:
    """Hyphens, hashes, dots, commas and (ASCII) word characters only."""
    return c.rlike(r"(?U)^[-#.,\w]+$" if unicode_words else "^[-#.,A-Za-z0-9_]+$")


def is_word(c: Column) -> Column:
    """An optional hash, hyphens, at least one word character of any script."""
    return c.rlike(r"(?U)^#?[-\w]*\w[-\w]*$")


def is_emoticon(words: Column) -> Column:
    """Every word is made of laughter, the letters of smileys and punctuation."""
    return F.forall(words, lambda w: w.rlike(r"(?i)^(?:ha|d|x|lol|\p{Punct})+$"))


def informative(tag: Column) -> Column:
    return F.substring(F.upper(tag), 1, 2).isin(*INFORMATIVE)


def not_punctuation(c: Column) -> Column:
    return ~c.rlike(r"^\p{Punct}+$")


def tab_fields(c: Column) -> Column:
    """Split on tab runs, with the blanks around them."""
    return F.split(c, " *\t+ *")


def span_to_ids(c: Column) -> Column:
    """``word_3..word_5,word_9`` to [3, 4, 5, 9]."""
    def part(p: Column) -> Column:
        ends = F.transform(F.split(p, r"\.\."), lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int"))
        return F.sequence(ends[0], F.element_at(ends, -1))

    return F.flatten(F.transform(F.split(c, ","), part))


def ids_to_span(ids: Column, prefix: str = "word_") -> Column:
    """The inverse: sorted distinct ids to ranges; runs are ids of equal ``id - rank``."""
    s = F.array_sort(F.array_distinct(ids))
    firsts = F.filter(s, lambda x: ~F.array_contains(s, x - 1))
    lasts = F.filter(s, lambda x: ~F.array_contains(s, x + 1))
    p = F.lit(prefix)
    return F.array_join(F.zip_with(firsts, lasts, lambda a, b: F.when(a == b, F.concat(p, a.cast("string"))).otherwise(F.concat(p, a.cast("string"), F.lit(".."), p, b.cast("string")))), ",")


#: What bare feature values stand for.
FEATURES = {
    "case": ["nom", "gen", "dat", "acc"],
    "gender": ["fem", "masc", "neut"],
    "num": ["sg", "pl"],
    "pers": ["1", "2", "3"],
    "mood": ["ind", "imp", "subj"],
    "tense": ["pres", "past"],
}


def features(c: Column) -> Column:
    """``k=v|k=v`` to a map; bare values are lower-cased and named by what they can be, others stand for themselves with ``True``."""

    def entry(x: Column) -> Column:
        low = F.lower(x)
        key = F.coalesce(*[F.when(low.isin(*values), F.lit(name)) for name, values in FEATURES.items()], low)
        value = F.when(low.isin(*[v for values in FEATURES.values() for v in values]), low).otherwise(F.lit("True"))
        kv = F.split(x, "=", 2)
        return F.when(x.contains("="), F.struct(kv[0].alias("key"), kv[1].alias("value"))).otherwise(F.struct(key.alias("key"), value.alias("value")))

    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: (x != "") & (x != "_"))
    # of entries with one key, the last counts
    entries = F.transform(parts, entry)
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries) + 1), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def features_string(m: Column) -> Column:
    """The inverse; an empty map is ``_``."""
    return F.when(F.coalesce(F.size(m), F.lit(0)) <= 0, "_").otherwise(F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|"))


def ascii_normalize(c: Column) -> Column:
    """Trimmed, with A-Z alone lower-cased."""
    return F.translate(F.trim(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean_translation(c: Column) -> Column:
    """A dictionary's entry without bracketed notes, placeholder pronouns and a leading ``to``."""
    notes = F.regexp_replace(c, r"\s*(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>)", "")
    plain = F.regexp_replace(notes, r"\b(?:sb|sth|jd|jdn|jdm|jds|etw)\b\.?(?:/(?:sb|sth|jd|jdn|jdm|jds|etw)\b\.?)*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"^\s*to\s+", ""), r"\s{2,}", " "))


#: One alternation, first match wins: addresses, emoticons, tags, numbers, words, dots, single marks.
TOKEN = "|".join(
    [
        r"https?://\S+|www\.\S+",
        r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
        r"(?:\+\d{1,3}[ /-]?)?\(?\d{2,5}\)?[ /-]\d{3,}(?:[ -]\d+)*",
        r"[<>]?[:;=8xX][-o*']?[()\[\]dDpP/\\|}{@3]+(?!\w)|<3+|\^[_.-]?\^",
        r"&#?\w+;",
        r"[#@][\w-]+",
        r"(?:\p{L}\.){2,}|(?:bzw|usw|etc|Dr|Prof|Nr|ca)\.",
        r"\d+(?:[.,:]\d+)*\.?(?!\w)",
        r"\.{2,}|…",
        r"[\p{L}\p{N}_]+(?:[-'’][\p{L}\p{N}_]+)*",
        r"[^\s]",
    ]
)


def decode_typography(c: Column) -> Column:
    out = c
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.translate(out, "“”„‘’‚–—", "\"\"\"'''--")


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(decode_typography(c), F.lit(f"({TOKEN})"), F.lit(1))


def either(patterns: list[str]) -> str:
    """Seed expressions as one alternation between blanks or the text's ends; nothing matches none."""
    return r"(?:^|\s)(?:" + "|".join(f"(?:{p})" for p in patterns) + r")(?:\s|$)" if patterns else r"(?!)"


def offsets(text: Column, words: Column) -> Column:
    """(word, start, end) of words that stand in ``text`` in order, each looked for after the one before."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<word:string,start:int,end:int>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        at = F.call_function("locate", w, text, s["at"])
        entry = F.struct(w.alias("word"), (at - 1).alias("start"), (at - 1 + F.length(w)).alias("end"))
        return F.struct((at + F.length(w)).alias("at"), F.concat(s["out"], F.array(entry)).alias("out"))

    return F.aggregate(words, start, step, lambda s: s["out"])
