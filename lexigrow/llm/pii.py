"""Personal data: exact base detectors plus a character BiLSTM-CRF.

The base detectors (email, ip, card, phone) are linear scans.  The tagger adds
forms that they miss (a phone without its country code, a card with dots, an
address with blanks round the at sign): a bidirectional LSTM over characters
with CRF transitions, trained in numpy from labelled spans that a seeded
generator writes into invented prose.

Every span must hold a digit or an ``@``: that is a hard constraint of the
tagger, so a stretch of text without either can only decode to "outside" and is
not evaluated.  Everything else is covered by overlapping windows, each decoded
by Viterbi, and their spans are reconciled per document by weighted interval
scheduling.  An added span must also pass its kind's check (Luhn, octets at
most 255, 8 to 15 digits) and may not touch a base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nn
from .common import DOCUMENT_COLUMNS, map_batches

KINDS = ("email", "ip", "card", "phone")
#: The longest added span; windows overlap by more, and reach as far from every digit and at sign.
LONGEST = 80
WINDOW, STRIDE, MARGIN, HIDDEN = 160, 160 - LONGEST - 2, LONGEST, 16
#: Characters of a training window.
TAUGHT = 96
#: An added span's least mean tag marginal.
CONFIDENCE = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]+")
#: Forms that the tagger learns; its spans are cut to the outermost of these characters.
CORE = {"email": re.compile(r"[^\W_](?:.*[^\W_])?", re.S), "ip": re.compile(r"[0-9].*[0-9]", re.S), "card": re.compile(r"[0-9].*[0-9]", re.S), "phone": re.compile(r"[+(0-9].*[0-9]", re.S)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each at sign outwards in linear time."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return out


# --- the tagger ---------------------------------------------------------------


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Code point to symbol: ASCII as it is, then other letters, other digits, other blanks, the rest."""
    table = np.full(0x10000, 131, np.int16)
    for c in range(128, 0x3000):
        table[c] = 128 if chr(c).isalpha() else 129 if chr(c).isdigit() else 130 if chr(c).isspace() else 131
    table[0x3000:0xD800] = 128
    table[:128] = np.arange(128)
    return table


SYMBOLS, PAD = 133, 132


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return symbol_table()[np.minimum(codes, 0xFFFF)]


def _valid_card(rng: np.random.Generator) -> str:
    head = "".join(map(str, [4, *rng.integers(0, 10, 14)]))
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def _sample(rng: np.random.Generator, kind: str) -> str:
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    if kind == "email":
        s = pick("", "", " ")
        return f"{word(rng.integers(2, 9))}{pick('', '.', '_')}{pick('', num(2), word(3), 'é' + word(3))}{s}@{s}{word(rng.integers(2, 7))}{pick('', num(1))}{s}.{s}{pick('com', 'org', 'net', 'example.com')}"
    if kind == "ip":
        return pick(".", ".", " . ", "[.]").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        c, s = _valid_card(rng), pick("", "", " ", "-", ".", "/")
        return s.join(c[i : i + 4] for i in range(0, 16, 4))
    a, b, c = num(3), num(3), num(4)
    return pick("+1 ", "+1 ", "+" + num(2) + " ", "", "", "1-") + pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}")


def _prose(rng: np.random.Generator, n: int) -> str:
    syl = ("th", "er", "on", "an", "re", "he", "in", "ed", "ou", "st", "é", "ver", "sch", "ción", "eau", "ü", "la", "de")
    out = []
    while sum(map(len, out)) + len(out) < n:
        w = "".join(syl[i] for i in rng.integers(0, len(syl), rng.integers(1, 4)))
        out.append(w.capitalize() if rng.random() < 0.1 else w)
        if rng.random() < 0.1:
            out[-1] += (".", ",", ".\n", ":")[rng.integers(4)]
    return " ".join(out)[:n]


def _distractor(rng: np.random.Generator) -> str:
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexes = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.integers(16, 41)))
    return (f'token = "{hexes}"', f"password={hexes[:18]}", num(rng.integers(1, 7)), f"{num(2)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(1)},{num(3)},{num(3)}", f"@{_prose(rng, 6).strip()}", num(rng.integers(20, 40)), f"{num(2)}:{num(2)}:{num(2)}", f"(c) {num(4)}")[rng.integers(11)]


def labelled_windows(rng: np.random.Generator, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags [T, count] of windows with generated spans; tag 0 is outside."""
    x, y = np.full((TAUGHT, count), PAD, np.int16), np.zeros((TAUGHT, count), np.int64)
    for b in range(count):
        text, tags = _prose(rng, int(rng.integers(0, 40))), []
        tags = [0] * len(text)
        for _ in range(int(rng.integers(1, 4))):
            text += " " * (rng.random() < 0.9)
            tags += [0] * (len(text) - len(tags))
            if rng.random() < 0.6:
                k = int(rng.integers(4))
                s = _sample(rng, KINDS[k])
                text, tags = text + s, tags + [k + 1] * len(s)
            else:
                text += _distractor(rng)
            text += (" ", ". ", ", ", "\n")[rng.integers(4)] + _prose(rng, int(rng.integers(0, 30)))
            tags += [0] * (len(text) - len(tags))
        at = int(rng.integers(0, max(1, len(text) - TAUGHT + 1)))
        text, tags = text[at : at + TAUGHT], tags[at : at + TAUGHT]
        x[: len(text), b], y[: len(tags), b] = symbols(text), tags
    return x, y


@lru_cache(maxsize=2)
def train(seed: int = 7, steps: int = 160, batch: int = 48) -> dict[str, np.ndarray]:
    """Weights from ``steps * batch`` generated windows; the same for every input and machine size."""
    rng = np.random.default_rng(seed)
    p = nn.init_recurrent(rng, SYMBOLS, HIDDEN, 4, len(KINDS) + 1)
    p["t"] = np.zeros((len(KINDS) + 1,) * 2, np.float32)
    opt = nn.Adam(p, 0.02)
    for step in range(steps):
        x, y = labelled_windows(rng, batch)
        opt.rate = 0.02 * (1 - 0.9 * step / steps)

        def loss(e):
            de, dt = nn.crf_loss(e, p["t"], y)
            return de, {"t": dt}

        opt.update(nn.emissions_grad(p, x, loss))
    return p


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over every stretch within MARGIN of a digit or an at sign."""
    spans: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out = []
    for a, b in spans:
        while b - a > WINDOW:
            out.append((a, a + WINDOW))
            a += STRIDE
        out.append((a, b))
    return out


def plausible(kind: str, s: str) -> bool:
    digits = "".join(DIGITS.findall(s))
    if kind == "email":
        return s.count("@") == 1 and "." in s.split("@")[1] and "\n" not in s and len(s) <= LONGEST
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and len(s) <= 24 and "." in s
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and len(s) <= 2 * len(digits) and not re.search(r"[^0-9 ./\-]", s)
    return 10 <= len(digits) <= 15 and len(s) <= 2 * len(digits) and bool(re.search(r"[0-9][)(. -]+[0-9]", s)) and not re.search(r"[^0-9 ().+\-]", s)


def schedule(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The non-overlapping choice of greatest summed score; ties keep the earlier span."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[2], s[3]))
    ends, best, take = [s[1] for s in spans], [0.0], []
    for i, s in enumerate(spans):
        j = bisect_right(ends, s[0], 0, i)
        w = best[j] + s[3]
        take.append((w > best[-1], j))
        best.append(max(best[-1], w))
    out, i = [], len(spans)
    while i:
        used, j = take[i - 1]
        if used:
            out.append(spans[i - 1])
        i = j if used else i - 1
    return out[::-1]


def _touches(spans: list[tuple[str, int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for _, x, y in spans)


def tagged_spans(p: dict[str, np.ndarray], texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The spans that the tagger adds to each text."""
    where = [(i, a, b) for i, text in enumerate(texts) for a, b in windows(text)]
    found: dict[int, list[tuple[int, int, str, float]]] = {}
    for at in range(0, len(where), 512):
        part = where[at : at + 512]
        x = np.full((WINDOW, len(part)), PAD, np.int16)
        for j, (i, a, b) in enumerate(part):
            x[: b - a, j] = symbols(texts[i][a:b])
        e = nn.emissions(p, x)
        path = nn.crf_viterbi(e, p["t"])
        some = np.flatnonzero(path.any(0))
        if not len(some):
            continue
        marginal = nn.crf_marginals(e[:, some], p["t"])
        for s, j in enumerate(some):
            i, a, b = part[j]
            tags, n = path[: b - a, j], b - a
            cuts = [0, *(np.flatnonzero(np.diff(tags)) + 1), n]
            for u, v in zip(cuts, cuts[1:]):
                k = int(tags[u])
                if not k or (u == 0 and a > 0) or (v == n and b < len(texts[i])):
                    continue  # outside, or cut by a window's edge: a neighbour holds it whole, as windows overlap by more than a span
                kind = KINDS[k - 1]
                m = CORE[kind].search(texts[i][a + u : a + v])
                sure = float(marginal[u:v, s, k].mean())
                if m and sure >= CONFIDENCE and plausible(kind, m[0]):
                    lo, hi = a + u + m.start(), a + u + m.end()
                    beside = texts[i][lo - 1 : lo] + texts[i][hi : hi + 1]
                    if not any(c.isalnum() for c in beside) and not _touches(base[i], lo, hi):
                        found.setdefault(i, []).append((lo, hi, kind, round(sure * (hi - lo), 6)))
    return [[(k, a, b) for a, b, k, _ in schedule(found[i])] if i in found else [] for i in range(len(texts))]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _all(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of base spans, their digest, all spans.

    A null text counts as empty: no spans, the digest of ``''``.  Ids may be null
    or repeated; rows are never merged.  Other columns of ``df`` are not read.
    Texts are scanned whole; a long text costs time in proportion to its length.
    """
    weights = train()

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        base = [base_spans(t) for t in texts]
        added = tagged_spans(weights, texts, base)
        counts = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS}
        return pd.DataFrame(
            {"doc_id": batch["doc_id"], **counts, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(_all(b, a)) for b, a in zip(base, added)], "n_added": [len(a) for a in added]}
        )

    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(map_batches(run), schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each span by ``<KIND>``; overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(text: Column) -> Column:
    """The text with personal data replaced; null stays null."""
    weights = train()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        plain = [t if isinstance(t, str) else "" for t in texts]
        base = [base_spans(t) for t in plain]
        added = tagged_spans(weights, plain, base)
        return pd.Series([redact(t, _all(b, a)) if isinstance(t, str) else None for t, b, a in zip(texts, base, added)], dtype=object)

    return run(text)


def pii_stage(df: DataFrame) -> DataFrame:
    """``documents`` with redacted texts and their new lengths; no row is dropped."""
    out = df.select(*DOCUMENT_COLUMNS).withColumn("text", redacted(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
