"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, numbered, shuffle_partitions
from .components import connected_components
from .jaccard import digest_of, parity, shingles, similar

#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 14
#: Members of a bucket that are compared in one task: a larger bucket is dealt into blocks and done block by block.
BUCKET = 4096
#: Symbols of a set of shingles, of which covering masks keep some.
SYMBOLS = 16
#: Nodes with neighbouring numbers of which one stands for the others in the first comparison.
NEAR = 64


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of 64-bit hashes as a signed integer: a bit is set if it is in over half of them; 0 for none."""
    ones = np.zeros(64, dtype="int64")
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int) -> int:
    """The SimHash of a text's word shingles, repeats included (XXH64, seed 42); 0 for no word."""
    return simhash(shingles(text, shingle, distinct=False)) if text.strip(" \t\n\v\f\r") else 0


def symbols(found: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of a set of shingle hashes, each under another mix (the finaliser of SplitMix64).

    Two sets differ in each with the probability 1 - Jaccard similarity, whatever their sizes and wherever their words differ.
    """
    out = np.empty(SYMBOLS, dtype="<u8")
    for k in range(SYMBOLS):
        x = found + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[k] = (x ^ (x >> np.uint64(31))).min()
    return out


def symbol_masks() -> np.ndarray:
    """The 63 masks over SYMBOLS symbols: the words of a linear code of 6 dimensions, of which each keeps 6 symbols or more.

    Symbol i has the vector of 1, its four bits, and one quadratic function of them (bent, so that every word is that heavy). Symbols that
    differ span at most as many dimensions, so up to 5 of them always have a mask that keeps none.
    """
    vector = [32 * ((i & 1 & i >> 1) ^ (i >> 2 & i >> 3 & 1)) + 16 + i for i in range(SYMBOLS)]
    return np.array([[(x & v).bit_count() & 1 for x in vector] for v in range(1, 64)], dtype="uint64")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The bit masks of a covering of so many bits: 2^(radius+1) - 1 of them, signed.

    Bit i is given the vector i mod (2^(radius+1) - 1) + 1 over GF(2), and mask v keeps the bits whose vector
    has an odd product with v. The vectors of at most radius differing bits span fewer than radius + 1
    dimensions, so some v is orthogonal to all of them: its mask keeps none of those bits, and the pair is equal under it.
    """
    n = (1 << (radius + 1)) - 1
    out = [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a minimum spanning forest over all pairs at radius or fewer bits, in linear space (Prim)."""
    n = len(fps)
    near, link, left = np.full(n, 65, dtype="int64"), np.zeros(n, dtype="int64"), np.ones(n, dtype=bool)
    u, v, at = [], [], 0
    for _ in range(n):
        left[at] = False
        gap = np.bitwise_count(fps ^ fps[at]).astype("int64")
        better = left & (gap < near)
        near[better], link[better] = gap[better], at
        if not left.any():
            break
        at = int(np.where(left, near, 99).argmin())
        if near[at] <= radius:
            u.append(at)
            v.append(link[at])
    return fps[u], fps[v]


def links(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that join all fingerprints within the radius; fps: distinct (fp).

    Every fingerprint goes into a bucket of each table. A bucket gives the edges of its spanning forest, so it
    loses no connection and gives fewer edges than members. A task compares at most bucket fingerprints at once: a
    larger bucket is dealt into blocks, and each pair of blocks gives a forest, with the same components.
    """
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(keys).alias("key"))

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows: finds the runs of equal keys, also across batches."""
        held: list[np.ndarray] = []  # the run that isn't over
        last, n = None, 0

        def done() -> pd.DataFrame | None:
            if last is None or n < 2:
                return None
            if n > bucket:
                return pd.DataFrame({"u": [None], "v": [None], "hot": [last]}).astype("Int64")
            u, v = forest(np.concatenate(held), radius)
            return pd.DataFrame({"u": u, "v": v, "hot": pd.array([None] * len(u), dtype="Int64")})

        for batch in batches:
            key, fps = batch["key"].to_numpy(), batch["fp"].to_numpy()
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            starts = np.append(0, ends[:-1])
            first = len(key) and last == key[0]
            many = (ends - starts > 1) | (np.arange(len(ends)) == len(ends) - 1) | (np.arange(len(ends)) == 0)
            out = []
            for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                if not (first and a == 0):
                    out.append(done())
                    held, last, n = [], int(key[a]), 0
                n += b - a
                if n <= bucket:
                    held.append(fps[a:b])
            if out := [x for x in out if x is not None]:
                yield pd.concat(out)
        if (x := done()) is not None:
            yield x

    found = materialize(rows.repartition("key").sortWithinPartitions("key").mapInPandas(small, "u long, v long, hot long"), "links")
    edges = found.where("hot is null").select("u", "v")
    hot = found.where("hot is not null").select(F.col("hot").alias("key"))
    if hot.isEmpty():
        return edges
    many = rows.join(hot.hint("merge"), "key")
    blocks = many.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket // 2)).cast("int").alias("g"))
    dealt = many.join(blocks.hint("merge"), "key").withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("g")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    pairs = dealt.select("key", "fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(rows["fp"].to_numpy(), radius)
        return pd.DataFrame({"u": u, "v": v})

    return edges.unionByName(pairs.groupBy("key", "i", "j").applyInPandas(pair, "u long, v long"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Groups documents by SimHash; one row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Two documents are linked if their fingerprints differ in at most radius bits, and component_id is the least
    identifier that links reach; it is null if they reach none. Null, empty and blank text has fingerprint zero and is
    linked like any other. Repeated rows share a component. An empty table gives an empty result; other columns are ignored.

    Equal fingerprints are one class, found by run and then across runs, so a class with a third of all rows
    is spread over many tasks in either direction.
    """

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle)).astype("int64")

    run = F.pmod(F.spark_partition_id(), F.lit(shuffle_partitions(docs.sparkSession)))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), of(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"), run.alias("run")), "fingerprints")
    local = rows.groupBy("run", "fp").agg(F.min("doc_id").alias("least"))
    classes = materialize(local.groupBy("fp").agg(F.min("least").alias("least")), "classes")
    found = connected_components(links(classes.select("fp"), radius))
    named = materialize(classes.join(found.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    reached = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_run = local.select("run", "fp").join(named.join(reached.hint("merge"), "component").select("fp", "component_id").hint("merge"), "fp")
    return rows.join(by_run.hint("merge"), ["run", "fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def table_keys(symbols_: np.ndarray, ms: np.ndarray) -> np.ndarray:
    """The bucket of each row of symbols in each table: a sum over the symbols that the mask keeps, and the table."""
    x = symbols_ * np.arange(1, 2 * SYMBOLS, 2, dtype="uint64") @ ms.T + np.arange(len(ms), dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view("int64")


def buckets(classes: DataFrame, bucket: int = BUCKET, few: int = 100_000) -> DataFrame:
    """(key, node, beside, block): what shares a bucket with another node, in any table.

    beside: the node that this one is compared with first. Of NEAR nodes with neighbouring numbers that is the first one in the bucket, and for that one the
    node before it (null for the first of all); so a group that meets in many buckets gives few different pairs, and each
    bucket's are a tree over its nodes.

    A bucket that is surely large, by a count of one node in 64, is dealt into blocks, so no task has to sort it all.
    This changes which task does the work, never the pairs that are compared.
    """
    ms = symbol_masks()

    @F.pandas_udf("array<long>")
    def keys(held: pd.Series) -> pd.Series:
        return pd.Series(list(table_keys(np.frombuffer(b"".join(held), dtype="<u8").reshape(len(held), SYMBOLS), ms)))

    rows = classes.select("node", F.explode(keys("symbols")).alias("key"))
    large = materialize(rows.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") * 64 >= bucket).select("key", F.ceil(F.col("k") * 64 * 2 / bucket).cast("int").alias("g")), "large-buckets")
    n = large.count()
    if n <= few:
        rows = rows.join(large.hint("broadcast"), "key", "left")  # so few rows
    else:
        salts = large.withColumn("salt", F.explode(F.array(*map(F.lit, range(16)))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(16)).cast("int")).join(salts.hint("merge"), ["key", "salt"], "left").drop("salt")
    rows = rows.withColumn("block", F.coalesce(F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")).cast("int"), F.lit(-1))).drop("g")
    by = W.partitionBy("key", "block").orderBy("node")
    rows = rows.withColumn("before", F.lag("node").over(by)).withColumn("after", F.lead("node").over(by))
    first = F.col("before").isNull() | (F.floor(F.col("before") / NEAR) != F.floor(F.col("node") / NEAR))
    rows = rows.withColumn("first", F.last(F.when(first, F.col("node")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    beside = F.when(F.col("first") == F.col("node"), F.col("before")).otherwise(F.col("first"))
    return rows.where("before is not null or after is not null or block >= 0").select("key", "node", beside.alias("beside"), "block")


def first_tables() -> np.ndarray:
    """For each set of equal symbols, as bits, the first mask whose symbols are all equal; -1 for none."""
    masks_ = (symbol_masks() << np.arange(SYMBOLS, dtype="uint64")).sum(axis=1).astype("int64")
    equal = np.arange(1 << SYMBOLS, dtype="int64")
    out = np.full(len(equal), -1, dtype="int64")
    for t in range(len(masks_))[::-1]:
        out[equal & masks_[t] == masks_[t]] = t
    return out


def block_pairs(shared: DataFrame, classes: DataFrame, least: float, block: int = BUCKET // 4, small: int = 64) -> DataFrame:
    """Candidate pairs (u, v) of rows (key, node, component) of one bucket but two components.

    A bucket of up to `small` nodes gives all its pairs. A larger one is dealt into blocks, and each pair of blocks is compared in one task: only pairs
    come out whose sizes and parities allow the similarity, and only from the first table that they share. No pair of that similarity is left out.
    """
    open_ = materialize(shared.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "k"), "open")
    few = shared.join(open_.where(F.col("k") <= small).hint("merge"), "key").select("key", "node", "component")
    a, b = (few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component")]) for x in "ab")
    pairs = a.join(b.hint("merge"), "key").where("node_a < node_b and component_a <> component_b").select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    many = open_.where(F.col("k") > small)
    if many.isEmpty():
        return pairs
    salts = F.explode(F.array(*map(F.lit, range(4))))
    groups = many.select("key", F.ceil(F.col("k") / F.lit(block)).cast("int").alias("g"), salts.alias("salt"))
    rows = shared.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(4)).cast("int")).join(groups.hint("merge"), ["key", "salt"])
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node", F.lit(2)), F.col("g")).cast("int"))
    marked = materialize(rows.select("key", "node", "component", "g", "i").join(classes.select("node", "n", "bits", "symbols").hint("merge"), "node"), "marked-buckets")
    # the pair of blocks (p, q), p <= q, has the rows of both
    dealt = marked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", "node", "component", "n", "bits", "symbols", "i", F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q"))
    first, ms = first_tables(), symbol_masks()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        node, component, n, i = (rows[c].to_numpy() for c in ("node", "component", "n", "i"))
        bits, held = (np.frombuffer(b"".join(rows[c]), dtype="<u8").reshape(len(rows), -1) for c in ("bits", "symbols"))
        table = int(np.flatnonzero(table_keys(held[:1], ms)[0] == rows["key"].iloc[0])[0])
        apart, powers = rows["p"].iloc[0] != rows["q"].iloc[0], 1 << np.arange(SYMBOLS)
        u, v = [], []
        for at in np.flatnonzero(i == rows["p"].iloc[0]).tolist():
            other = np.flatnonzero((component != component[at]) & ((i != i[at]) if apart else (node > node[at])))
            size = n[other] + n[at]
            other = other[np.minimum(n[other], n[at]) + 1e-9 >= least * np.maximum(n[other], n[at])]
            size = n[other] + n[at]
            other = other[np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1) <= size * (1 - least) / (1 + least) + 1e-9]
            other = other[first[(held[other] == held[at]) @ powers] == table]
            u.append(np.full(len(other), node[at]))
            v.append(node[other])
        return pd.DataFrame({"u": np.concatenate(u) if u else [], "v": np.concatenate(v) if v else []}, dtype="int64")

    return pairs.unionByName(dealt.groupBy("key", "p", "q").applyInPandas(compare, "u long, v long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups near copies; one row per input row: doc_id, text_sha256, component_id, kept.

    Candidates are the pairs whose sets of word shingles are equal in all symbols (minima of the hashed sets) of one of 63 covering masks:
    every pair with at most 5 of 16 symbols unlike, and many others; a pair of similarity 0.8 is one with a probability of 0.95, of 0.9 with 0.998.
    So they depend on the two texts alone. A candidate is a link if the sets have at least that Jaccard similarity, checked on the sets. component_id is the least identifier that links reach, and one document of each
    component is kept: that with the least identifier, null ones last, and the least digest of its text. Rows that repeat
    identifier and text are one document. Null, empty and blank text is one set. An empty table gives an empty result; other
    columns are ignored.

    Equal sets are one class. A tree over each bucket is compared first; what it joins isn't compared
    pair by pair, as its component is known, so a large group of near copies costs few comparisons.
    """

    @F.pandas_udf("digest binary, n int, bits binary, symbols binary")
    def mark(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, shingle) for t in texts]
        return pd.DataFrame({"digest": [digest_of(s) for s in sets], "n": [len(s) for s in sets], "bits": [parity(s) for s in sets], "symbols": [symbols(s).tobytes() for s in sets]})

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    marked = materialize(texts.select("doc_id", "key", mark("text").alias("m"), F.spark_partition_id().alias("run")).select("doc_id", "key", "run", "m.*"), "marked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    local = marked.groupBy("run", "digest").agg(F.min(first).alias("first"), F.first(F.struct("n", "bits", "symbols")).alias("m"))
    classes = local.groupBy("digest").agg(F.min("first").alias("first"), F.first("m").alias("m"))
    classes = numbered(classes.select("digest", "first", F.col("first.key").alias("key"), "m.*"), "node", "classes")
    shared = materialize(buckets(classes), "shared")
    beside = shared.where("beside is not null").select(F.col("beside").alias("u"), F.col("node").alias("v"))
    edges = similar(beside, classes, texts, shingle, similarity)
    known = materialize(connected_components(edges), "known")
    placed = shared.select("key", "node").join(known.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    more = similar(block_pairs(materialize(placed, "placed"), classes, similarity), classes, texts, shingle, similarity)
    found = classes.join(connected_components(edges.unionByName(more)).hint("merge"), "node", "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
    found = materialize(found, "found")
    named = found.join(found.groupBy("component").agg(F.min("first").alias("stays")).hint("merge"), "component").select("digest", "stays")
    by_run = local.select("run", "digest").join(named.hint("merge"), "digest")
    out = marked.select("run", "digest", "key", "doc_id").join(by_run.hint("merge"), ["run", "digest"])
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("key") == F.col("stays.key"))
    return out.select("doc_id", F.lower(F.hex("key")).alias("text_sha256"), F.col("stays.doc_id").alias("component_id"), kept.alias("kept"))
