"""Language-model scores of texts by a probabilistic suffix tree."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Longest context in bytes, and the byte that ends a text (no word has it).
DEPTH, END = 5, 10
#: Bytes whose windows are sorted at once, and bytes of a text that are scored as one row of a matrix.
SORTED, ROW = 2 << 20, 1024


def tokens(text: str) -> list[bytes]:
    """Words; bytes, so that only A-Z are lowered and only space and 0x09-0x0D split."""
    return text.encode().lower().split()


def windows(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """A number for each symbol: it is the last byte, and its context of up to DEPTH bytes stands before it.

    A part is a stretch of a text and the up to DEPTH bytes before it (the end symbol stands before a text). A context doesn't
    reach over the start of its text; missing bytes are 0.
    """
    data = np.frombuffer(b"".join(before + p for before, p in parts), dtype="uint8")
    wide = np.concatenate((np.zeros(DEPTH, "uint8"), data)).astype("uint64")
    code, reach = data.astype("uint64"), np.ones(len(data), dtype=bool)
    for k in range(1, DEPTH + 1):
        byte = wide[DEPTH - k : len(wide) - k]
        code |= np.where(reach, byte, 0).astype("uint64") << np.uint64(8 * k)
        reach &= byte != END
    own = np.repeat(np.tile([False, True], len(parts)), [len(x) for part in parts for x in part])  # what stands before isn't predicted here
    return code[own]


def stretches(body: bytes, size: int = SORTED) -> Iterator[tuple[bytes, bytes]]:
    """A text and its end as stretches of at most so many bytes, each with the bytes before it."""
    s = bytes([END]) + body + bytes([END])
    for a in range(1, len(s), size):
        yield s[max(0, a - DEPTH) : a], s[a : a + size]


def counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal codes."""
    all_, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_)
    all_, n = all_[order], n[order]
    first = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])) if len(all_) else np.zeros(0, dtype="int64")
    return all_[first], np.add.reduceat(n, first) if len(first) else n


def cut(docs: DataFrame, held_out: Column, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_id, held_out, body): the words of each text with single spaces, in blocks of about block_bytes.

    A block is a stretch of a partition, so rows that share an identifier or a text are spread as all others are. It is written,
    so a row keeps its block.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, block, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            bodies = [b" ".join(tokens(t)) for t in batch["text"]]
            at = []
            for x in bodies:
                if size and size + len(x) > block_bytes:
                    block, size = block + 1, 0
                size += len(x)
                at.append(first + block)
            yield pd.DataFrame({"block": at, "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "body": bodies})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(rows.mapInPandas(blocks, "block long, doc_id long, held_out boolean, body binary"), "bodies", compression="zstd")


def window_counts(train: DataFrame) -> DataFrame:
    """(code, n) over all training texts: one row per task and code, then summed."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, held, size = [], [], [], 0

        def settle() -> None:
            c, n = np.unique(windows(held), return_counts=True)
            codes.append(c)
            counts.append(n)
            if len(codes) > 5:
                c, n = counted(codes, counts)
                codes[:], counts[:] = [c], [n]

        for batch in batches:
            for body in batch["body"]:
                for part in stretches(body):
                    held.append(part)
                    size += len(part[1])
                    if size >= SORTED:
                        settle()
                        held, size = [], 0
        if held:
            settle()
        if codes:
            c, n = counted(codes, counts)
            for a in range(0, len(c), 1 << 18):
                yield pd.DataFrame({"code": c[a : a + (1 << 18)].astype("int64"), "n": n[a : a + (1 << 18)].astype("int64")})

    return train.select("body").mapInPandas(local, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def contexts(counts: DataFrame, least_share: float, least_count: int, evidence: float) -> pd.DataFrame:
    """The retained contexts: depth, context, next symbol, n.

    A candidate occurs least_count times or more and at least least_share of all times. It is retained if
    2 n KL(next | context || next | context without its first symbol) exceeds evidence * ln(its occurrences) for each
    free next symbol. The empty context always is. There are at most 1 / least_share of each depth, however large the
    corpus, and only what is retained comes to the driver.
    """
    mask = F.create_map(*[F.lit(x) for k in range(DEPTH + 1) for x in (k, (1 << (8 * k)) - 1)])
    size = F.ceil(F.length(F.ltrim(F.hex(F.shiftright("code", 8)), F.lit("0"))) / 2).cast("int")  # bytes of the context
    levels = counts.withColumn("k", F.explode(F.sequence(F.lit(0), size))).select("k", F.shiftright("code", 8).bitwiseAND(F.element_at(mask, F.col("k"))).alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).alias("next"), "n")
    each = materialize(levels.groupBy("k", "ctx", "next").agg(F.sum("n").alias("n")), "contexts")
    all_ = each.where("k = 0").agg(F.sum("n")).first()[0] or 0
    total = each.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where((F.col("k") == 0) | (F.col("total") >= F.lit(max(float(least_count), least_share * all_))))
    rows = materialize(each.join(total.hint("merge"), ["k", "ctx"]), "candidates")
    up = rows.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("up"), "next", F.col("n").alias("un"), F.col("total").alias("ut"))
    gain = rows.where("k > 0").withColumn("up", F.col("ctx").bitwiseAND(F.element_at(mask, F.col("k") - 1))).join(up.hint("merge"), ["k", "up", "next"])
    gain = gain.groupBy("k", "ctx").agg((2 * F.sum(F.col("n") * F.log(F.col("n") * F.col("ut") / (F.col("total") * F.col("un"))))).alias("g"), F.first("total").alias("t"), F.first("kinds").alias("f"))
    passed = gain.where(F.col("g") > F.lit(evidence) * F.col("f") * F.log("t")).select("k", "ctx")
    kept = rows.join(passed.hint("merge"), ["k", "ctx"], "left_semi").unionByName(rows.where("k = 0"))
    return kept.select(F.col("k").cast("byte").alias("k"), "ctx", F.col("next").cast("short").alias("next"), "n").toArrow().to_pandas()  # Arrow: no object for each row on the driver


class Model:
    """The retained contexts with their smoothed next-symbol distributions, as arrays.

    A state is the longest suffix of what has been read that is a retained context or part of one. Its distribution is
    (counts + inertia * that of its own longest proper suffix) / (their sum + inertia); the empty context's has half a
    count for each byte more. Every distribution sums to one over the 256 bytes: those never met in training share one column.
    """

    def __init__(self, rows: pd.DataFrame, inertia: float):
        root = np.zeros(256)
        r = rows[rows["k"] == 0]
        root[r["next"].to_numpy()] = r["n"].to_numpy()
        seen = np.flatnonzero(root)
        width, unseen = len(seen) + 1, 256 - len(seen)  # the last column is for all bytes that training lacks
        self.classes = np.full(256, width - 1, dtype="int64")
        self.classes[seen] = np.arange(len(seen))
        self.within = np.zeros(256)  # log10 of a byte's share in its column
        self.within[root == 0] = -math.log10(max(1, unseen))
        base = np.append(root[seen] + 0.5, 0.5 * unseen) / (root.sum() + 128)
        rows = rows[rows["k"] > 0].sort_values(["k", "ctx"], kind="stable")
        key = (rows["k"].to_numpy("int64") << 48) | rows["ctx"].to_numpy("int64")
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        nexts, ns = self.classes[rows["next"].to_numpy("int64")], rows["n"].to_numpy(float)
        own = {int(key[a] & ((1 << 48) - 1)).to_bytes(int(key[a] >> 48), "big"): (a, b) for a, b in zip(starts.tolist(), np.append(starts, len(key))[1:].tolist(), strict=True)}
        # suffixes stay as the chain of back-offs, prefixes so that a state and a symbol give the next state
        stays = {c[i:j] for c in own for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
        order = [b"", *sorted(stays, key=lambda c: (len(c), c))]
        number = {c: i for i, c in enumerate(order)}
        self.after = np.zeros((len(order), width), dtype="int32")
        shares = np.empty((len(order), width), dtype="float32")
        shares[0] = base
        for size, group in groupby(order, len):
            group = list(group)
            for c in group if size else ():
                self.after[number[c[:-1]], self.classes[c[-1]]] = number[c]
            for c in group if size else ():  # shorter states are complete now
                i, above = number[c], number[c[1:]]
                self.after[i] = self.after[above]
                shares[i] = shares[above]
                if c in own:
                    a, b = own[c]
                    n = ns[a:b]
                    shares[i] *= inertia / (n.sum() + inertia)
                    np.add.at(shares[i], nexts[a:b], n / (n.sum() + inertia))
        self.logs = np.log10(shares, out=shares)

    def logs_of(self, parts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each symbol of all parts, one after the other; rows of ROW bytes go through the automaton side by side."""
        out, rows, at = np.empty(sum(map(len, parts)), dtype="float32"), [], 0
        for k, p in enumerate(parts):
            rows += [(k, a, at + a) for a in range(0, len(p), ROW)]
            at += len(p)
        for first in range(0, len(rows), 1024):
            some = rows[first : first + 1024]
            grid = np.full((DEPTH + ROW, len(some)), END, dtype="uint8")
            for j, (k, a, _) in enumerate(some):
                head, body = parts[k][max(0, a - DEPTH) : a], parts[k][a : a + ROW]
                grid[DEPTH - len(head) : DEPTH, j] = np.frombuffer(head, "uint8")
                grid[DEPTH : DEPTH + len(body), j] = np.frombuffer(body, "uint8")
            state, logs = np.zeros(len(some), dtype="int32"), np.empty((len(some), ROW), dtype="float32")
            for t in range(DEPTH + max(min(ROW, len(parts[k]) - a) for k, a, _ in some)):
                c = self.classes[grid[t]]
                if t >= DEPTH:
                    logs[:, t - DEPTH] = self.logs[state, c] + self.within[grid[t]]
                state = self.after[state, c]
            for j, (k, a, to) in enumerate(some):
                n = min(ROW, len(parts[k]) - a)
                out[to : to + n] = logs[j, :n]
        return out

def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, block_bytes: int = 5 << 20, least_share: float = 2e-6, least_count: int = 20, evidence: float = 0.5, inertia: float = 16.0) -> DataFrame:
    """Scores every text with a suffix tree, and with a word baseline, learnt from those that aren't held out.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Held out are
    rows whose crc32(doc_id as text) mod folds is held_out; a null identifier counts as an empty text there and is
    learnt from. Null text is empty: it has the end token only. Repeated rows are learnt from as often as they
    occur. An empty table gives an empty result; other columns are ignored.

    The suffix tree runs over the bytes of the lower-cased words with single spaces and the end, and score is the sum of
    their log10 probabilities in it, so it is a probability over all texts, in any script. The counts of all windows of
    training text are shuffled and grow with the corpus; the tree made of them has at most 1 / least_share contexts of
    each depth and is broadcast. For the baseline, words are known by 64-bit hashes: a block sends its distinct words to be
    counted and gets their counts back, so no row is made for each word of each document.
    """
    spark = docs.sparkSession
    rest = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    bodies = cut(docs, rest == held_out, block_bytes, id_col, text_col)
    model = spark.sparkContext.broadcast(Model(contexts(window_counts(bodies.where("not held_out")), least_share, least_count, evidence), inertia))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The words of each block and their training counts; a block that two tasks read gives some words twice."""
        import xxhash

        block, count = None, Counter()

        def done() -> pd.DataFrame:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in count), "uint64", len(count)).view("int64")
            return pd.DataFrame({"block": block, "word": words, "n": np.fromiter(count.values(), "int64", len(count))})

        for batch in batches:
            for at, out, body in zip(batch["block"], batch["held_out"], batch["body"], strict=True):
                if at != block:
                    if block is not None:
                        yield done()
                    block, count = at, Counter()
                found = [*body.split(), b"\n"]
                if out:
                    count.update(dict.fromkeys(found, 0))
                else:
                    count.update(found)
        if block is not None:
            yield done()

    # a word has a row or two for each block at most, so no partition has more than its share
    dealt = bodies.select("block", "held_out", "body").mapInPandas(distinct, "block long, word long, n long").repartition("word")
    counts = dealt.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("r"))
    told = materialize(dealt.join(counts.hint("merge"), "word").select("block", "word", "n", "c", "r"), "words")
    n = told.agg(F.sum("n")).first()[0] or 0
    v = sum(k // r for r, k in told.where("c > 0").groupBy("r").count().collect())  # a row for each number of rows that words have
    low = math.log10(n + 0.5 * (v + 1))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        count = dict(zip(right["word"].to_numpy().view("uint64").tolist(), right["c"].tolist(), strict=True))
        h = xxhash.xxh64_intdigest

        class Logs(dict):
            def __missing__(self, word: bytes) -> float:
                found = self[word] = math.log10(count[h(word)] + 0.5) - low
                return found

        logs, unknown, out = Logs(), math.log10(0.5) - low, []
        for body in left["body"]:
            each = [*map(logs.__getitem__, body.split()), logs[b"\n"]]
            out.append((len(each), len(each) - each.count(unknown), math.fsum(each)))
        tokens_, known_, base = zip(*out, strict=True)
        parts = [body + bytes([END]) for body in left["body"]]
        starts = np.cumsum([0, *map(len, parts[:-1])])
        score = np.add.reduceat(model.value.logs_of(parts).astype("float64"), starts)
        return pd.DataFrame({"doc_id": left["doc_id"].astype("Int64"), "held_out": left["held_out"], "n_tokens": tokens_, "n_known": known_, "train_tokens": n, "base_score": base, "score": score})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return bodies.groupBy("block").cogroup(told.select("block", "word", "c").groupBy("block")).applyInPandas(score, schema)
