"""Token counts without building the tokens: by a unigram model's best path and by a BPE model's merges.

The best path (``Counter``): an Aho-Corasick automaton enumerates all vocabulary
pieces in a segment; dynamic programming carries, for each end position, the
best score and its piece count.  Ties follow the tokenizer: of the pieces that
end at one place the one that starts first is offered first, and only a strictly
better score replaces an earlier one.  A character that no single-character
piece covers costs the lowest score less ten.

The public vocabulary at hand belongs to a BPE model, whose own counts are
another matter: it merges the neighbours of best score, of equal scores the
leftmost, until no two neighbours make a piece (``Merges``).  So the operator
gives both: the model's own count, and that of the same pieces and scores taken
as a unigram model.  In both an uncovered character counts as its UTF-8 bytes
(byte fallback).

Pieces never hold a blank mark after another character, so a text falls into
independent segments (blank marks, then other characters); each distinct segment
is solved once per worker.  Pieces and scores are never trained here.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Most distinct segments that a worker remembers.
MEMO = 500_000
#: Segments up to this long are merged without a heap.
SHORT = 48


def vocabulary(path: str = f"{TOKENIZERS}/{MODEL}") -> list[tuple[str, float]]:
    """Normal pieces and scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - 10
        self.chained = any(MARK in p.lstrip(MARK) for p, _ in vocab)
        self.memo: dict[str, int] = {}

    def segment(self, s: str) -> int:
        """Matches come by their ends, of one end the longest first: so ties go to the earliest start."""
        n, unknown, never = len(s), self.unknown, float("-inf")
        best, count = [0.0] + [never] * n, [0] * (n + 1)
        at, single = 0, False

        def alone(i: int) -> None:
            """The character at i stands for its bytes."""
            if best[i] + unknown > best[i + 1]:
                best[i + 1], count[i + 1] = best[i] + unknown, count[i] + len(s[i].encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.automaton.iter(s):
            while at < end:
                if not single:
                    alone(at)
                at, single = at + 1, False
            found = best[end + 1 - length] + score
            if found > best[end + 1]:
                best[end + 1], count[end + 1] = found, count[end + 1 - length] + 1
            single = single or length == 1
        while at < n:
            if not single:
                alone(at)
            at, single = at + 1, False
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a text: blanks become marks and one mark is put in front, as the model's rules say."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.chained:
            return self.segment(marked)
        memo, total = self.memo, 0
        for s in SEGMENT.findall(marked):
            k = memo.get(s)
            if k is None:
                if len(memo) >= MEMO:
                    memo.clear()
                k = memo[s] = self.segment(s)
            total += k
        return total


class Merges(Counter):
    """Counts of a BPE model."""

    def __init__(self, vocab: list[tuple[str, float]]) -> None:
        self.scores = dict(vocab)
        self.chained = any(MARK in p.lstrip(MARK) for p in self.scores)
        self.memo: dict[str, int] = {}

    def segment(self, s: str) -> int:
        return self.short(s) if len(s) <= SHORT else self.long(s)

    def short(self, s: str) -> int:
        """The pair of best score, of equal ones the leftmost, found anew after each merge."""
        get, never, parts = self.scores.get, float("-inf"), list(s)
        pairs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (top := max(pairs)) > never:
            i = pairs.index(top)
            piece = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + piece, never)
            if i < len(pairs):
                pairs[i] = get(piece + parts[i + 1], never)
        return sum(1 if p in self.scores else len(p.encode("utf-8", "surrogatepass")) for p in parts)

    def long(self, s: str) -> int:
        scores, n = self.scores, len(s)
        parts: list[str] = list(s)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            score = scores.get(piece := parts[i] + parts[j])
            if score is not None:
                heapq.heappush(heap, (-score, i, j, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != len(piece):
                continue  # one of them has been merged since
            parts[i], parts[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return sum(1 if p in scores else len(p.encode("utf-8", "surrogatepass")) for p in parts if p)


def is_bpe(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type == model.trainer_spec.BPE


class Both(Counter):
    """Counts of a BPE model and of the same pieces and scores taken as a unigram model, as one number."""

    def __init__(self, vocab: list[tuple[str, float]], bpe: bool) -> None:
        self.unigram, self.merges = Counter(vocab), Merges(vocab) if bpe else None
        self.chained, self.memo = self.unigram.chained, {}

    def segment(self, s: str) -> int:
        best = self.unigram.segment(s)
        return (best << 32) + (self.merges.segment(s) if self.merges else best)


def token_counts(df: DataFrame, path: str = f"{TOKENIZERS}/{MODEL}", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_unigram): one row per input row.

    ``n_unigram`` is the best path's number of pieces by the unigram rules;
    ``n_tokens`` is the count of the model's own ``encode``: for a BPE model that
    of its merges, for a unigram model ``n_unigram`` again.  Null and empty texts
    have none.  Ids may be null or repeated; rows are never merged.
    """
    vocab = vocabulary(path)  # 32,000 pieces: a fixed size
    bpe = is_bpe(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Both(vocab, bpe)
        for batch in batches:
            counts = np.array([counter.count(t) if isinstance(t, str) else 0 for t in batch["text"]], np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts & 0xFFFFFFFF, "n_unigram": counts >> 32})

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {dict(df.dtypes)[id_col]}, n_tokens long, n_unigram long")
