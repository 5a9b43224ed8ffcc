"""Jaccard similarity of sets of word shingles: exact checks of pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits of a set's parities, and how many digests of 32 bytes may be broadcast.
BITS, BROADCAST_ROWS = 512, 200_000


def shingles(text: str, shingle: int, distinct: bool = True) -> np.ndarray:
    """The hashes (XXH64, seed 42) of a text's word shingles, sorted if distinct; a shorter text is one shingle."""
    import xxhash

    found = text.encode().lower().split()  # bytes: only A-Z are lowered, only space and 0x09-0x0D split
    joined, k, h = b" ".join(found), min(shingle, len(found)), xxhash.xxh64_intdigest
    if not k:
        return np.array([h(b"", 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, found), "int64", len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = np.array([h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)], dtype="<u8")
    return np.unique(out) if distinct else out


def digest_of(found: np.ndarray) -> bytes:
    """The name of a set of shingles: the first 128 bits of its SHA-256."""
    return hashlib.sha256(found.tobytes()).digest()[:16]


def parity(found: np.ndarray) -> bytes:
    """BITS bits: each is the parity of the shingles that fall on it, so two sets differ in at least as many shingles as bits."""
    return np.packbits(np.bincount(((found >> np.uint64(24)) % np.uint64(BITS)).astype("int64"), minlength=BITS) & 1).tobytes()


def similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingles have a Jaccard similarity of at least so much.

    classes: (node, key, n, bits), the digest of a text of each node, the size and the parities of its set; texts: (key, text). Sets of that similarity differ in at most (1 - least) / (1 + least) of their joint size, so pairs whose parities differ
    in more bits are out before the sets are made.
    """
    once = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series, size: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), dtype="<u8").reshape(len(c), -1) for c in (a, b))
        return pd.Series(np.bitwise_count(x ^ y).sum(axis=1) <= size.to_numpy() * (1 - least) / (1 + least) + 1e-9)

    mark = lambda x, node: classes.select(F.col("node").alias(node), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")).hint("merge")
    sized = once.join(mark("a", "u"), "u").join(mark("b", "v"), "v").where(F.least("n_a", "n_b") + F.lit(1e-9) >= F.lit(least) * F.greatest("n_a", "n_b"))
    pairs = materialize(sized.where(maybe("bits_a", "bits_b", F.col("n_a") + F.col("n_b"))).select("u", "v"), "pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes.select("node", "key").hint("merge"), "node")
    ends = materialize(ends, "ends")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "s": [shingles(t, shingle).view("int64") for t in batch["text"]]})

    few = ends.count() <= BROADCAST_ROWS
    held = texts.join(ends.hint("broadcast" if few else "merge"), "key").select("node", "text")
    made = materialize(held.mapInPandas(sets, "node long, s array<long>").dropDuplicates(["node"]), "shingles")  # several rows may have the text
    both = pairs.join(made.select(F.col("node").alias("u"), F.col("s").alias("a")).hint("merge"), "u").join(made.select(F.col("node").alias("v"), F.col("s").alias("b")).hint("merge"), "v")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: np.ndarray, y: np.ndarray) -> bool:
            common = len(np.intersect1d(x, y, assume_unique=True))  # sets are distinct and sorted
            return common + 1e-9 >= least * (len(x) + len(y) - common)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return materialize(both.where(near("a", "b")).select("u", "v"), "similar")
