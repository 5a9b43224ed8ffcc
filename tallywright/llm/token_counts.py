"""Token counts by heap-and-linked-list pair merging over a sentencepiece BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments remembered by a Python worker; the memory is emptied when full.
REMEMBERED = 1_500_000


class Counts(dict):
    """Segment -> count; what is missing is counted. before goes in front of each segment."""

    def __init__(self, count, before: str = ""):
        self.count, self.before = count, before

    def __missing__(self, segment: str) -> int:
        found = self.count(self.before + segment)
        if len(segment) < 64:
            self[segment] = found
        return found


class PairCounter:
    """Counts the tokens of a text; it never builds identifiers.

    The symbols of a segment form a linked list and its adjacent pairs a heap, ordered by the rank of the
    merged piece and then from left to right. The best pair is popped until none is left that the vocabulary
    has; a segment has as many tokens as initial symbols (one for a known character, one for each UTF-8 byte
    of another) less merges. A text is cut where no piece can reach across: before a space (pieces have the
    space mark in front only), around line breaks, and between any two characters that are adjacent in no piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("a piece has a space mark behind another character, or a line break")
        self.pieces = sorted((p for p in self.rank if SPACE * 2 not in p), key=self.rank.get)
        self.place = {p: i for i, p in enumerate(self.pieces)}
        self.joint = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.plain, self.spaced = Counts(self.parted), Counts(self.parted, SPACE)

    def segment(self, text: str) -> int:
        """Of a segment without cuts; the heap holds place in the ranking and position as one number."""
        if SPACE * 2 in text or len(text) > 65535:
            return self.any_segment(text)
        place, pieces, syms = self.place.get, self.pieces, list(text)
        n = total = len(syms)
        for c in syms:
            if c > "\x7f" and place(c) is None:
                total += len(c.encode()) - 1
        heap = [r << 16 | i for i in range(n - 1) if (r := place(text[i : i + 2])) is not None]
        if not heap:
            return total
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, p = top & 65535, pieces[top >> 16]
            j = after[i]
            if j >= n or syms[i] + syms[j] != p or not syms[i]:
                continue  # one of the two has been merged meanwhile
            total -= 1
            syms[i], syms[j] = p, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := place(p + syms[k])) is not None:
                    heappush(heap, r << 16 | i)
            h = before[i]
            if h >= 0 and (r := place(syms[h] + p)) is not None:
                heappush(heap, r << 16 | h)
        return total

    def any_segment(self, text: str) -> int:
        """The same for runs of spaces, whose pieces share one rank, and for very long segments."""
        rank, syms = self.rank, list(text)
        n = len(syms)
        total = n + sum(len(c.encode()) - 1 for c in syms if c not in rank and c > "\x7f")
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := syms[i] + syms[i + 1]) in rank]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, p = heappop(heap)
            j = after[i]
            if not syms[i] or j >= n or len(syms[i]) + len(syms[j]) != len(p) or syms[i] + syms[j] != p:
                continue  # one of the two has been merged meanwhile
            total -= 1
            syms[i], syms[j] = p, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := p + syms[k]) in rank:
                    heappush(heap, (rank[q], i, q))
            if (h := before[i]) >= 0 and (q := syms[h] + p) in rank:
                heappush(heap, (rank[q], h, q))
        return total

    def parted(self, text: str) -> int:
        if text[1:].isalpha():
            return self.segment(text)
        cuts = [0, *[i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joint], len(text)]
        if len(cuts) == 2:
            return self.segment(text)
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return sum(self.spaced[p[1:]] if p[0] == SPACE and len(p) > 1 and p[1] != SPACE else self.plain[p] for p in parts)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if len(self.plain) + len(self.spaced) > REMEMBERED:
            self.plain.clear()
            self.spaced.clear()
        lines = text.replace(SPACE, " ").split("\n")
        total = len(lines) - 1  # a line break is one byte
        lines[0] = " " + lines[0]
        for line in lines:
            words = line.split(" ")
            total += self.plain[words[0]] if words[0] else 0
            del words[0]
            if "" not in words:
                total += sum(map(self.spaced.__getitem__, words))
                continue
            spaces = 1
            for word in words:
                if word:
                    total += self.spaced[word] if spaces == 1 else self.parted(SPACE * spaces + word)
                    spaces = 1
                else:
                    spaces += 1
            total += self.parted(SPACE * (spaces - 1)) if spaces > 1 else 0
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PairCounter:
    """One for each Python worker."""
    return PairCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    model is the path of a sentencepiece BPE model with identity normalisation, the same on every executor.
    Null text counts as empty and has no tokens; very long texts are counted whole, a line at a time; repeated
    rows are counted each; other columns are ignored; an empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(model)
        for texts in batches:
            yield texts.map(of)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
