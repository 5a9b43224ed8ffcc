"""Phrase collocations by streams of counts in prefix and in suffix order, merged in lockstep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: What ends a piece, and what separates words: fixed values of the query's contract. Ends become a byte that UTF-8 doesn't have.
END = b"\xff"
TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", END * 10 + b" ")
#: Bytes of text that are counted at once in a task; bits a frequent phrase has in the filter, and the most bits.
BLOCK, PER_PHRASE, MOST_BITS = 3_000_000, 16, 1 << 30
#: Tasks that the phrases with one first word are dealt over.
SALTS = 16


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of phrases that are one word longer, for the filter only."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    return x ^ (x >> np.uint64(29))


def place(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)) % np.uint64(bits)


def kept(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = place(keys, len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype("int64")] >> (at & np.uint64(7)).astype("uint8") & 1).astype(bool)


class Block:
    """The words of some texts as numbers: codes (-1: the end of a piece), the words by code, and their keys."""

    def __init__(self, texts: list[bytes], lang: str) -> None:
        import xxhash

        data = np.frombuffer(END.join(texts).lower().translate(TABLE), dtype="uint8")  # bytes: only A-Z are lowered
        space, end = data == 0x20, data == END[0]
        begins = ~space & (end | np.append(True, (space | end)[:-1])[: len(data)])  # an end is a word of its own
        offsets = np.append((np.cumsum(~space, dtype="int32") - 1)[begins], np.count_nonzero(~space)).astype("int32")
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
        self.codes, self.names = words.indices.to_numpy().astype("int64"), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        salt = xxhash.xxh64_intdigest(lang, 7)
        self.hashed = np.array([xxhash.xxh64_intdigest(w, 42) ^ salt for w in self.names], dtype="uint64")
        if END in self.names:
            self.codes[self.codes == self.names.index(END)] = -1

    def words(self) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        much = np.bincount(self.codes[self.codes >= 0], minlength=len(self.names))
        some = np.flatnonzero(much)
        return [[self.names[i].decode()] for i in some.tolist()], self.hashed[some], much[some]

    def begins(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of n words begin, and their keys."""
        at = np.flatnonzero(self.codes >= 0)
        keys = self.hashed[self.codes[at]]
        for k in range(1, n):
            near = at + k < len(self.codes)
            at, keys = at[near], keys[near]
            near = self.codes[at + k] >= 0
            at, keys = at[near], keys[near]
            keys = mixed(keys, self.hashed[self.codes[at + k]])
        return at, keys

    def parted(self, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of n words begin whose first and last n - 1 words are both in the filter, and their keys."""
        at, keys = self.begins(n - 1)
        good = kept(keys, bits)
        at, keys = at[good], keys[good]
        begins = np.zeros(len(self.codes) + 1, dtype=bool)
        begins[at] = True
        both = begins[at + 1]
        at, keys = at[both], keys[both]
        return at, mixed(keys, self.hashed[self.codes[at + n - 1]])

    def phrases(self, n: int, at: np.ndarray, keys: np.ndarray) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The different phrases of n words at the places, sorted, with their keys and how often they occur."""
        if not len(at):
            return [], keys, at
        rows = np.stack([self.codes[at + k] for k in range(n)])
        order = np.lexsort(rows[::-1])
        sorted_ = rows[:, order]
        first = np.flatnonzero(np.append(True, (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)))
        much = np.diff(np.append(first, len(order)))
        return [[self.names[c].decode() for c in p] for p in sorted_[:, first].T.tolist()], keys[order[first]], much


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    """The texts (lang, text as bytes) of a task, some at a time, by language."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text")
        for i, lang in enumerate(langs):
            text = texts[i].as_py()
            waiting.setdefault(lang, []).append(text)
            size += len(text)
            if size > BLOCK:
                for x in list(waiting):
                    yield x, Block(waiting.pop(x), x)
                size = 0
    for x in list(waiting):
        yield x, Block(waiting.pop(x), x)


def counted_keys(docs: DataFrame, n: int, may: np.ndarray) -> DataFrame:
    """(key, f) of phrases of n words whose parts are in the filter: how often a key occurs, which is at least as often as each of its phrases."""
    held = docs.sparkSession.sparkContext.broadcast(may)  # MOST_BITS at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches):
            keys, much = np.unique(block.parted(n, held.value)[1], return_counts=True)
            yield pa.record_batch({"key": keys.view("int64"), "f": much})

    return docs.mapInArrow(count, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def counted(docs: DataFrame, own: int = 0, parted: int = 0, may: np.ndarray | None = None) -> DataFrame:
    """(lang, words, key, f) of phrases that may be frequent; docs: (lang, text).

    Those of `own` words whose key is in the filter, and those of `parted` words whose first and last parts are; without a
    filter, all words.
    """
    held = None if may is None else docs.sparkSession.sparkContext.broadcast(may)  # MOST_BITS at most

    def found(block: Block) -> Iterator[tuple]:
        if held is None:
            yield block.words()
        if own:
            at, keys = block.begins(own)
            good = kept(keys, held.value)
            yield block.phrases(own, at[good], keys[good])
        if parted:
            yield block.phrases(parted, *block.parted(parted, held.value))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks(batches):
            for words, keys, much in found(block):
                if len(words):
                    yield pa.record_batch({"lang": pa.array([lang] * len(words), pa.string()), "words": pa.array(words, pa.list_(pa.string())), "key": keys.view("int64"), "f": much.astype("int64")})

    rows = docs.mapInArrow(count, "lang string, words array<string>, key long, f long")
    return rows.groupBy("lang", "words").agg(F.first("key").alias("key"), F.sum("f").alias("f"))


def filter_of(frequent: DataFrame) -> np.ndarray:
    """Bits at the places of the phrases' keys: so many for each phrase, at least 4,096 and at most MOST_BITS.

    Tasks set the bits of ranges of places; the driver joins the ranges, whose sum has that bound. With more phrases than bits it only lets more through.
    """
    n = frequent.count()
    bits = 4096
    while bits < min(n * PER_PHRASE, MOST_BITS):
        bits *= 2
    piece = max(4096, bits >> 12)

    def ranges(rows: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(piece // 8, dtype="uint8")
        at = rows["at"].to_numpy() % piece
        np.bitwise_or.at(part, at >> 3, (1 << (at & 7)).astype("uint8"))
        return pd.DataFrame({"range": [rows["at"].iloc[0] // piece], "part": [part.tobytes()]})

    @F.pandas_udf("long")
    def places(keys: pd.Series) -> pd.Series:
        return pd.Series(place(keys.to_numpy().view("uint64"), bits).astype("int64"))

    rows = frequent.select(places("key").alias("at")).distinct().withColumn("range", F.floor(F.col("at") / piece).cast("long"))
    out = np.zeros(bits // 8, dtype="uint8")
    for r in rows.groupBy("range").applyInPandas(ranges, "range long, part binary").toLocalIterator():
        out[r["range"] * piece // 8 : (r["range"] + 1) * piece // 8] = np.frombuffer(r["part"], dtype="uint8")
    return out


def lockstep(stream: DataFrame, suffix: bool) -> DataFrame:
    """One pass over all orders in prefix order (in suffix order: the words reversed).

    Sorted so, a phrase comes right after its beginnings. The pass holds the counts of the current beginnings, and so gives
    each phrase theirs, and each beginning the count of its most frequent extension. Phrases with one first word are dealt
    by the second; single words, which are no candidates, go to every such part.
    stream: (lang, words, f, [before]); result: lang, words, f, parts (counts of the beginnings of 1, 2 ... words) and more (that of the extension).
    """
    order = F.reverse("words") if suffix else F.col("words")
    keyed = stream.withColumn("o", order).withColumn("salts", F.when(F.size("o") == 1, F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.pmod(F.xxhash64(F.get("o", F.lit(1))), F.lit(SALTS)).cast("int"))))
    names = [c for c in stream.columns if c not in ("lang", "words", "f")]
    dealt = keyed.select("lang", "o", "f", *names, F.explode("salts").alias("salt")).withColumn("w", F.get("o", F.lit(0)))
    sorted_ = dealt.repartition("lang", "w", "salt").sortWithinPartitions("lang", "salt", "o")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []  # [words, f, others, most frequent extension, parts], one for each beginning
        at = None

        def row(x: list) -> tuple:
            return (at[0], x[0][::-1] if suffix else x[0], x[1], *x[2], x[4], x[3])

        columns = ["lang", "words", "f", *names, "parts", "more"]
        for batch in batches:
            out = []
            for lang, salt, o, f, *others in zip(batch["lang"], batch["salt"], batch["o"], batch["f"], *[batch[c] for c in names], strict=True):
                o = list(o)
                keep = len(o) - 1 if at == (lang, salt) else 0
                while len(stack) > keep or stack and stack[-1][0] != o[: len(stack)]:
                    x = stack.pop()
                    if len(x[0]) > 1:
                        out.append(row(x))
                at = (lang, salt)
                if stack:
                    stack[-1][3] = max(stack[-1][3], f)
                stack.append([o, f, others, 0, [x[1] for x in stack]])
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([row(x) for x in reversed(stack) if len(x[0]) > 1], columns=columns)

    kinds = dict(stream.dtypes)
    schema = ", ".join(["lang string", "words array<string>", "f long", *[f"{c} {kinds[c]}" for c in names], "parts array<long>", "more long"])
    return sorted_.drop("w").mapInPandas(merge, schema)


def scored(rows: DataFrame, drop: int) -> DataFrame:
    """The candidates that stay, with the cut of least score: lang, phrase, a, l, r, score; rows: (lang, words, f, left, right, more)."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, words, a, left, right, more in zip(*[batch[c] for c in ("lang", "words", "f", "left", "right", "more")], strict=True):
                a = int(a)
                if 100 * int(more) >= drop * a:
                    continue
                # right has the counts of the last 1, 2 ... words
                cuts = [(2_000_000 * a // (int(x) + int(y)), k, int(x), int(y)) for k, (x, y) in enumerate(zip(left, right[::-1], strict=True))]
                score, _, x, y = min(cuts)
                out.append((lang, " ".join(words), a, x, y, score))
            yield pd.DataFrame(out, columns=["lang", "phrase", "a", "l", "r", "score"])

    return rows.mapInPandas(best, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", most_words: int = 4, least: int = 30, drop: int = 80, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language by how seldom their parts occur apart: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and into words at spaces and tabs. a is how often a phrase of 2 to
    most_words words occurs, l and r how often its two parts do at the cut that gives the least score floor(2000000 a / (l + r)); n counts the language's
    words. A phrase with a >= least is a candidate, and goes if a longer candidate around it has at least drop percent of its count. Ranks go by score, count, and
    the bytes of the phrase. Null text has no words, null language is "und"; rows that repeat count again. Other columns are ignored; no candidate gives an empty result.

    A pass over the texts counts words, the next one pairs by 64-bit keys only, whose two words are frequent. Keys that occur often enough make a
    filter; the third pass counts the pairs that are in it, and the phrases of three words whose two parts are, by their words; and so on: a part of a frequent phrase is as
    frequent. What a filter lets through wrongly is dropped by the exact count. Blocks are sorted and added up before anything is shuffled, so a
    word that is a third of all words has a row for each block. Only frequent phrases go on to the two merges.
    """
    lang: Column = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")) if lang_col else F.lit("und")
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words = materialize(counted(texts), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = lambda df, name: materialize(df.where(F.col("f") >= least), name)
    frequent = [often(words, "frequent")]
    may = filter_of(often(counted_keys(texts, 2, filter_of(frequent[0])), "keys"))
    found = often(counted(texts, 2, 3 if most_words > 2 else 0, may), "phrases3")
    frequent += [found.where(F.size("words") == n) for n in range(2, min(3, most_words) + 1)]
    for n in range(4, most_words + 1):
        frequent.append(often(counted(texts, 0, n, filter_of(frequent[-1])), f"phrases{n}"))
    stream = frequent[0].select("lang", "words", "f")
    for x in frequent[1:]:
        stream = stream.unionByName(x.select("lang", "words", "f"))
    singles = frequent[0].select("lang", "words", "f", F.expr("CAST(array() AS array<bigint>)").alias("left"), F.lit(0).cast("long").alias("after"))
    by_prefix = materialize(lockstep(stream, False).select("lang", "words", "f", F.col("parts").alias("left"), F.col("more").alias("after")), "prefix")
    both = lockstep(by_prefix.unionByName(singles), True).select("lang", "words", "f", "left", F.col("parts").alias("right"), F.greatest("after", "more").alias("more"))
    found = materialize(scored(both, drop), "scored")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("k", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*by))).where(F.col("k") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
