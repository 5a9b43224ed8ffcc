"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import json
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, numbered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Kinds of sequences, in the last bits of a sequence_id: packed in the first deal, packed in the second, one full piece.
FIRST, SECOND, FULL = 0, 1, 2
#: Words whose identifiers a Python worker remembers; the memory is emptied when full.
REMEMBERED = 600_000
#: Characters that are surely not white space for any library.
SOLID = "[!-~\u00c0-\u024f]+"


class Words(dict):
    """Word -> identifiers; what is missing is encoded, with before in front of it."""

    def __init__(self, encode, before: str = ""):
        self.encode, self.before = encode, before
        self.solid = re.compile(SOLID).fullmatch

    def __missing__(self, word: str) -> bytes:
        if not self.solid(word):
            raise KeyError(word)
        found = self.encode(self.before + word)
        if len(word) < 64:
            self[word] = found
        return found


class Encoder:
    """The identifiers of a byte-level BPE file as little-endian unsigned 32-bit bytes.

    The file's vocabulary and merges are given to tiktoken, which finds the same identifiers several times
    faster than the library of the file. The split pattern of such files cuts before a space that a solid
    character follows, and around a line break between solid characters, so these words are encoded on their own and
    remembered; a text with any other white space goes to tiktoken as it is.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path) as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(self.alphabet())}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.ids = {k: np.uint32(v).tobytes() for k, v in special.items()}
        spaces = [i for t, i in ranks.items() if t[:1] == b" "]
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)  # whether a token begins with a space
        self.opens[spaces] = True
        self.first, self.spaced, self.line_break = Words(self.ordinary), Words(self.ordinary, " "), self.ordinary("\n")

    @staticmethod
    def alphabet() -> list[str]:
        """The character that stands for each byte in such files: printable ones for themselves, others from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    def __call__(self, text: str) -> bytes:
        parts = self.special.split(text) if self.special and any(s in text for s in self.ids) else [text]
        return b"".join(self.ids.get(p) or self.plain(p) for p in parts if p)

    def ordinary(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes many words at once; a word's identifiers begin where a token begins with a space."""
        if all(map(self.spaced.solid, words)):
            ids = np.array(self.encode(" " + " ".join(words)), dtype="<u4")
            ends, ids = [*np.flatnonzero(self.opens[ids])[1:].tolist(), len(ids)], ids.tobytes()
            a = 0
            for word, b in zip(words, ends, strict=True):
                if len(word) < 64:
                    self.spaced[word] = ids[4 * a : 4 * b]
                a = b

    def plain(self, text: str) -> bytes:
        if len(self.first) + len(self.spaced) > REMEMBERED:
            self.first.clear()
            self.spaced.clear()
        try:
            out = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                found = list(map(self.spaced.get, rest))
                if None in found:
                    self.learn(list({w for w, ids in zip(rest, found, strict=True) if ids is None}))
                    found = map(self.spaced.__getitem__, rest)
                out += (self.line_break, self.first[first], *found)
            return b"".join(out[1:])
        except KeyError:
            return self.ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its identifiers and a closing 0, cut from the end into pieces of size."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                ends = range(n - (n - 1) // size * size, n + 1, size)  # the first piece may be shorter
                for k, end in enumerate(ends):
                    start = ends[k - 1] if k else 0
                    rows.append((doc, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(cut, PIECES)


class Packing:
    """A solution: bins of item numbers, every item in one bin."""

    def __init__(self, bins: list[list[int]], lengths: list[int]):
        self.bins, self.fill = bins, [sum(lengths[i] for i in b) for b in bins]

    def worth(self) -> tuple[int, int]:
        return len(self.bins), -sum(f * f for f in self.fill)


def best_fit(bins: list[list[int]], fill: list[int], items: list[int], lengths: list[int], size: int) -> list[list[int]]:
    """Puts each item into the fullest bin that has room for it, or a new one."""
    room = sorted((size - f, b) for b, f in enumerate(fill))
    for i in items:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = size, len(bins)
            bins.append([i])
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return bins


def crossover(a: Packing, b: Packing, lengths: list[int], size: int, rng: random.Random) -> Packing:
    """Injects whole well-filled bins of b into a, drops the bins of a that hold duplicates, and best-fits the displaced items."""
    full = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])[: max(1, len(b.bins) // 2)]
    taken = [b.bins[k] for k in full if rng.random() < 0.5]
    own = {i for x in taken for i in x}
    whole, displaced = [list(x) for x in taken], []
    worst = min(a.fill, default=0)
    for x, fill in zip(a.bins, a.fill, strict=True):
        if fill > worst and own.isdisjoint(x):
            whole.append(list(x))
        else:  # also the emptiest bin, or no bin would ever go
            displaced += [i for i in x if i not in own]
    displaced.sort(key=lambda i: -lengths[i])
    return Packing(best_fit(whole, [sum(lengths[i] for i in x) for x in whole], displaced, lengths, size), lengths)


def evolve(lengths: list[int], elites: list[list[list[int]]], size: int, population: int, generations: int, rng: random.Random) -> Packing:
    """The best packing after some generations, from elites and best-fit packings of slightly shuffled orders."""
    people = [Packing(e, lengths) for e in elites if e]
    while len(people) < population:
        noise = 0.15 * len(people)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + noise * (rng.random() - 0.5)))
        people.append(Packing(best_fit([], [], order, lengths, size), lengths))
    bound = -(-sum(lengths) // size)
    for _ in range(generations):
        people.sort(key=Packing.worth)
        if len(people[0].bins) <= bound:
            break
        a, b = rng.sample(range(len(people)), 2)
        people[-1] = crossover(people[min(a, b)], people[max(a, b)], lengths, size, rng)
    return min(people, key=Packing.worth)


def islands(items: DataFrame, size: int, seed: int, n_islands: int, rounds: int, population: int, generations: int) -> DataFrame:
    """Packs each shard of items (shard, item, length): the best of its islands, with a bin number.

    An island is one group of a shard's items. After each round its elite packing stays and also migrates to
    the next island of the shard, where the next round crosses the two.
    """
    schema = "shard long, island int, item long, length long, bin int, worth0 long, worth1 long"

    def live(at: int):
        def one(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(keys[0]), int(keys[1])
            rng = random.Random(f"{seed}/{shard}/{island}/{at}")
            rows = rows.sort_values(["length", "item"], ascending=[False, True])
            own = rows[rows["origin"] == island] if at else rows
            own = own.reset_index(drop=True)
            lengths = own["length"].tolist()
            elites = []
            for _, e in rows.groupby("origin", sort=True) if at else []:
                bins: list[list[int]] = [[] for _ in range(int(e["bin"].max()) + 1)]
                for i, b in enumerate(e["bin"].tolist()):  # the same order of items in each elite
                    bins[b].append(i)
                elites.append(bins)
            best = evolve(lengths, elites, size, population, generations, rng)
            of = np.empty(len(lengths), dtype="int32")
            for b, x in enumerate(best.bins):
                of[x] = b
            return own[["item", "length"]].assign(shard=shard, island=island, bin=of, worth0=best.worth()[0], worth1=best.worth()[1])[[c.split()[0] for c in schema.split(", ")]]

        return one

    state = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(n_islands - 1)))).groupBy("shard", "island").applyInPandas(live(0), schema)
    for at in range(1, rounds):
        sent = F.array_distinct(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(n_islands)).cast("int")))
        moved = state.withColumn("origin", F.col("island")).withColumn("island", F.explode(sent))
        state = moved.groupBy("shard", "island").applyInPandas(live(at), schema)
    state = materialize(state, "islands")
    best = state.groupBy("shard").agg(F.min(F.struct("worth0", "worth1", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    return state.join(best.hint("merge"), ["shard", "island"]).select("shard", "item", "length", "bin")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", shard_items: int = 1024, n_islands: int = 2, rounds: int = 2, population: int = 4, generations: int = 8, well_filled: float = 0.97, seed: int = 7) -> DataFrame:
    """Packs all documents into sequences of at most size tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text is empty and
    still has its closing identifier, so every row gives a piece; null identifiers stay null. Repeated rows are
    packed each. Only documents longer than size are cut. Other columns are ignored, and an empty table gives
    an empty result. Pieces are told apart by a number of their own, so rows may share an identifier, a text or both;
    which sequence a piece gets depends on these numbers, the rows and the seed.

    Items are dealt by hash into shards of about shard_items, so a task's memory doesn't grow with the input.
    What lies in bins under well_filled goes through a second deal across shards, so that the loss at the
    rim of a shard is made good; full pieces have a sequence of their own.
    """
    rows = numbered(pieces(docs, tokenizer, size, id_col, text_col), "item", "pieces")
    short = rows.where(F.col("length") < size)

    def deal(items: DataFrame, salt: int) -> DataFrame:
        shards = max(1, -(-items.count() // shard_items))
        return items.select(F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(shards)).alias("shard"), "item", "length")

    first = islands(deal(short, 1), size, seed, n_islands, rounds, population, generations)
    fill = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    first = materialize(first.join(fill.hint("merge"), ["shard", "bin"]), "packed")
    second = islands(deal(first.where(F.col("fill") < well_filled * size), 2), size, seed + 1, n_islands, rounds, population, generations)
    where = lambda kind: ((F.col("shard") * F.lit(1 << 20) + F.col("bin")) * F.lit(4) + F.lit(kind)).alias("sequence_id")
    placed = first.where(F.col("fill") >= well_filled * size).select("item", where(FIRST)).unionByName(second.select("item", where(SECOND)))
    alone = rows.where(F.col("length") >= size).select("*", (F.col("item") * F.lit(4) + F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    by = W.partitionBy("sequence_id").orderBy("item").rowsBetween(W.unboundedPreceding, -1)  # a sequence has at most size pieces
    joined = short.join(placed.hint("merge"), "item").withColumn("offset", F.coalesce(F.sum("length").over(by), F.lit(0)).cast("long"))
    return joined.unionByName(alone).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
