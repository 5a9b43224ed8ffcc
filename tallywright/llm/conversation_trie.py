"""The prefix trie of conversations, as minimal-perfect-hash node tables of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.operators.numbering import numbered

from .common import materialize

#: Rows of one conversation that are dealt together when a table of conversations is joined back.
BLOCK = 4096
#: Rows of a shard, turns of a conversation that stay in one shard, identifiers in one string of a list of members.
SHARD_ROWS, SEGMENT, LIST = 200_000, 16_384, 4096

LOCAL = "shard long, slot long, p1 long, p2 long, parent_slot long, q1 long, q2 long, depth long, n_bytes long, n long, low long, ends long"


class PerfectHash:
    """Numbers 0 to n - 1, without gaps, for n distinct keys of two 64-bit words.

    Level by level, keys that fall on a cell alone get the number of that cell among such cells, and the others go to the next level.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) > 100:
                raise ValueError("two keys are equal")
            at = self.cells(a[left], b[left], len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + base))
            base += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def cells(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a.view("uint64") ^ np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ b.view("uint64")) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype("int64")

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for some keys that aren't in the table (others must be told apart by comparing keys)."""
        out, left = np.full(len(a), -1, dtype="int64"), np.arange(len(a))
        for level, (alone, number) in enumerate(self.levels):
            at = self.cells(a[left], b[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = number[at[hit]]
            left = left[~hit]
        return out


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns with their place: conv_id, pos (from 1), n (turns of the conversation), block, digest, n_bytes.

    The order is by turn, null first; of equal turns by the digest of role and text, and rows that repeat one turn are so
    many turns. Null role or text counts as empty. Rows without conv_id belong to no conversation and are left out. Texts
    aren't moved, only their digests; a conversation with a third of all rows is dealt over many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("tie"))
    placed = numbered(rows, "conv_id", "turn", "digest", "tie", name="place", start=0).withColumn("block", F.floor(F.col("place") / BLOCK)).select("conv_id", "place", "block", "digest", "n_bytes")
    placed = materialize(placed, "places")
    of = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    dealt = of.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))))
    return placed.join(dealt.hint("merge"), ["conv_id", "block"]).select("conv_id", (F.col("place") - F.col("first") + 1).alias("pos"), "n", "block", "digest", "n_bytes")


def rebuilt(placed: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The turns of conversations that take over a beginning: conv_id, pos, length, digest, n_bytes, with a row at pos 0 for each.

    Conversation c begins with the first h turns of conversation c - c % group (h: CRC-32 of its decimal number modulo most + 1)
    and goes on with its own turns after its first h. It may have no turn at all.
    """
    placed = materialize(placed, "placed")
    convs = placed.groupBy("conv_id", "block").agg(F.max("n").alias("n"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("head"))
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.expr("array()"))
    plan = convs.join(heads.hint("merge"), "base", "left").withColumn("head", head).withColumn("k", F.size("head")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "block", "h", "k", "length", "head"), "plan")
    own = placed.join(plan.drop("head").hint("merge"), ["conv_id", "block"]).where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "length", "digest", "n_bytes")
    once = plan.groupBy("conv_id").agg(F.first("length").alias("length"), F.first("head").alias("head"))
    begin = once.select("conv_id", F.explode("head").alias("t"), "length").select("conv_id", F.col("t.pos").alias("pos"), "length", "t.digest", "t.n_bytes")
    root = once.select("conv_id", F.lit(0).cast("long").alias("pos"), "length", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return own.unionByName(begin).unionByName(root)


def as_they_are(placed: DataFrame) -> DataFrame:
    """The same rows as rebuilt() for conversations that keep their own turns."""
    rows = placed.select("conv_id", "pos", F.col("n").alias("length"), "digest", "n_bytes")
    root = placed.groupBy("conv_id").agg(F.max("n").alias("length")).select("conv_id", F.lit(0).cast("long").alias("pos"), "length", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return rows.unionByName(root)


def node_table(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard, by slot: counts scattered from the rows, and the slot of the parent.

    rows: (shard, conv_id, seg, pos, m1, m2, n_bytes, last, edge). A prefix's digest is the exclusive or of its turns' marks; every slot is
    checked to hold one digest, one parent, one depth and one length.
    """
    rows = rows.iloc[np.lexsort((rows["pos"].to_numpy(), rows["seg"].to_numpy(), rows["conv_id"].to_numpy()))]
    conv, seg, pos, n_bytes = (rows[c].to_numpy() for c in ("conv_id", "seg", "pos", "n_bytes"))
    last, edge = rows["last"].to_numpy(dtype=bool), rows["edge"].to_numpy(dtype=bool)
    begins = np.append(True, (conv[1:] != conv[:-1]) | (seg[1:] != seg[:-1]))
    run = np.cumsum(begins) - 1
    p = []
    for c in ("m1", "m2"):
        x = np.bitwise_xor.accumulate(rows[c].to_numpy())
        p.append(x ^ np.append(0, x[np.flatnonzero(begins)[1:] - 1])[run])
    order = np.lexsort((p[1], p[0]))
    new = np.append(True, (p[0][order][1:] != p[0][order][:-1]) | (p[1][order][1:] != p[1][order][:-1]))
    key = [x[order][new] for x in p]
    table = PerfectHash(*key)
    n = len(key[0])
    held, slots = [np.empty(n, dtype="int64") for _ in p], table.slots(*p)
    for h, k in zip(held, key, strict=True):
        h[table.slots(*key)] = k
    depth, length, parent = np.empty(n, dtype="int64"), np.empty(n, dtype="int64"), np.full(n, -1, dtype="int64")
    depth[slots] = pos
    real, child = ~edge, np.flatnonzero(~begins)
    length[slots[edge]] = 0
    length[slots[real]] = n_bytes[real]
    parent[slots[child]] = slots[child - 1]
    same = (held[0][slots] == p[0]).all() and (held[1][slots] == p[1]).all() and (depth[slots] == pos).all() and (length[slots[real]] == n_bytes[real]).all() and (parent[slots[child]] == slots[child - 1]).all()
    if not same:
        raise ValueError("two prefixes have one digest")
    count, ends, low = (np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64"), np.full(n, np.iinfo("int64").max))
    np.add.at(count, slots[real], 1)
    np.add.at(ends, slots[real & last], 1)
    np.minimum.at(low, slots[real], conv[real])
    up = np.maximum(parent, 0)
    none = parent < 0
    return pd.DataFrame({"shard": rows["shard"].iloc[0], "slot": np.arange(n), "p1": held[0], "p2": held[1], "parent_slot": parent, "q1": np.where(none, 0, held[0][up]), "q2": np.where(none, 0, held[1][up]), "depth": depth, "n_bytes": length, "n": count, "low": low, "ends": ends})


def accumulated(nodes: pd.DataFrame, segment: int) -> pd.DataFrame:
    """Sums over the subtrees of one shard, from the deepest nodes up through the slots of the parents; one row per node.

    nodes: those of node_table with g_low (the least member of all shards), own (whether this shard counts the node), leaves and saved.
    Sums don't pass from one segment of conversations to the one above, which gets them with its own rows.
    """
    by = nodes.sort_values("slot")
    depth, parent, low = (by[c].to_numpy() for c in ("depth", "parent_slot", "g_low"))
    own = by["own"].to_numpy(dtype=bool)
    leaves, saved, children = by["leaves"].to_numpy().copy(), by["saved"].to_numpy().copy(), np.zeros(len(by), dtype="int64")
    kids = own & (parent >= 0)
    np.add.at(children, parent[kids], 1)
    order = np.argsort(-depth, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(depth[order])) + 1, len(order))
    start = 0
    for end in ends:  # one depth after the other
        level = order[start:end]
        start = end
        d = depth[level[0]]
        if d == 0 or (d > 1 and (d - 1) % segment == 0):
            continue
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pd.array(np.where(kids, low[np.maximum(parent, 0)], 0), dtype="Int64")
    above[~kids] = pd.NA
    return pd.DataFrame({"p1": by["p1"], "p2": by["p2"], "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "parent_conv_id": above})


def lists_of_members(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of (p1, p2, conv_id): the SHA-256 of the members' decimal numbers, ascending, joined by commas.

    Members are sorted by ranges, written as strings of up to LIST numbers, and hashed string by string in order: a digest is made of its bytes in
    order, so one task sees all strings of a node, one at a time, whatever their number.
    """

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p1, p2, ids = (batch[c].to_numpy() for c in ("p1", "p2", "conv_id"))
            new = np.append(True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]))
            starts = np.flatnonzero(new)
            begins = np.concatenate([np.arange(a, b, LIST) for a, b in zip(starts.tolist(), np.append(starts[1:], len(ids)).tolist(), strict=True)])
            texts = list(map(str, ids.tolist()))
            parts = [",".join(texts[a:b]) for a, b in zip(begins.tolist(), np.append(begins[1:], len(ids)).tolist(), strict=True)]
            yield pd.DataFrame({"p1": p1[begins], "p2": p2[begins], "first": ids[begins], "part": parts})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, part in zip(batch["p1"].tolist(), batch["p2"].tolist(), batch["part"], strict=True):
                if key != (a, b):
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            yield pd.DataFrame(out, columns=["p1", "p2", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["p1", "p2", "ends_sha256"])

    parts = ends.repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id").mapInPandas(strings, "p1 long, p2 long, first long, part string")
    return parts.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInPandas(hashed, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, shard_rows: int = SHARD_ROWS, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the prefix trie of conversations; one row per distinct prefix.

    rows: those of rebuilt() or as_they_are(). Result: conv_id (least member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's n_convs - 1 times the bytes of its last text), ends_sha256. No conversation gives no node.

    Conversations are dealt into shards by hash, long ones in segments, so a shard has about shard_rows rows. A shard enumerates its distinct
    prefixes, gives each a slot and scatters its counts into arrays; the shards' counts of a prefix are added up (a row of each shard
    at most, also for a first turn that a third of all conversations share). Then the shard with the least member counts the
    node: it adds leaves and bytes up through its parent slots, and sums over shards give the subtree's, as all ancestors of a node lie in the shard of any member.
    """
    mark = lambda seed: F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "pos", "digest"))
    seg = lambda c: F.floor(F.greatest(c - 1, F.lit(0)) / segment).cast("long")
    marked = materialize(rows.select("conv_id", "pos", "length", "n_bytes", mark(1).alias("m1"), mark(2).alias("m2"), seg(F.col("pos")).alias("seg")), "marked")
    total, longest = marked.agg(F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(0))).first()
    shards = -(-total // shard_rows) or 1

    def shard(conv: str, at: Column) -> Column:
        return F.pmod(F.xxhash64(conv, at), F.lit(shards))

    columns = ["conv_id", "seg", "pos", "m1", "m2", "n_bytes", "last", "edge"]
    items = marked.select("conv_id", "seg", "pos", "m1", "m2", "n_bytes", (F.col("pos") == F.col("length")).alias("last"), F.lit(False).alias("edge"))
    edges = None
    if longest > segment:  # a segment begins with the digest of all before it
        sums = marked.where(F.col("length") > segment).groupBy("conv_id", "seg").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
        before = W.partitionBy("conv_id").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
        edges = materialize(sums.select("conv_id", "seg", *[F.bit_xor(f"x{i}").over(before).alias(f"m{i}") for i in (1, 2)]), "edges")
        items = items.unionByName(edges.where("seg > 0").select("conv_id", "seg", (F.col("seg") * segment).alias("pos"), "m1", "m2", F.lit(0).cast("long").alias("n_bytes"), F.lit(False).alias("last"), F.lit(True).alias("edge")).select(*columns))
    dealt = items.withColumn("shard", shard("conv_id", F.col("seg")))
    local = materialize(dealt.groupBy("shard").applyInPandas(node_table, LOCAL), "local")

    whole = local.where("n > 0").withColumn("same", F.xxhash64("q1", "q2", "depth", "n_bytes"))
    whole = whole.groupBy("p1", "p2").agg(F.sum("n").alias("g_n"), F.min("low").alias("g_low"), F.sum("ends").alias("g_ends"), F.min("same").alias("a"), F.max("same").alias("b"))
    whole = whole.withColumn("g_n", F.when(F.col("a") == F.col("b"), F.col("g_n")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))).drop("a", "b")
    own = (F.col("n") > 0) & (F.col("low") == F.col("g_low"))
    both = local.join(whole.hint("merge"), ["p1", "p2"]).withColumn("own", own)
    both = both.withColumn("leaves", F.when(F.col("own") & (F.col("g_ends") == F.col("g_n")), 1).otherwise(0).cast("long")).withColumn("saved", F.when(F.col("own"), (F.col("g_n") - 1) * F.col("n_bytes")).otherwise(0).cast("long"))
    both = materialize(both, "counted")
    if edges is not None:  # what later segments of a conversation count goes to the ends of its earlier ones
        of = both.where("own").select(F.col("g_low").alias("conv_id"), seg(F.col("depth")).alias("seg"), "leaves", "saved")
        sums = edges.select("conv_id", "seg").join(of.hint("merge"), ["conv_id", "seg"], "left").groupBy("conv_id", "seg").agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
        later = W.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(W.unboundedPreceding, 0)
        passed = sums.where("seg > 0").select("conv_id", "seg", *[F.sum(c).over(later).alias(f"more_{c}") for c in ("leaves", "saved")])
        passed = passed.join(edges.hint("merge"), ["conv_id", "seg"]).select(F.col("m1").alias("p1"), F.col("m2").alias("p2"), shard("conv_id", F.col("seg") - 1).alias("shard"), "more_leaves", "more_saved")
        passed = materialize(passed.groupBy("shard", "p1", "p2").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved")), "passed")
        both = both.join(passed.hint("merge"), ["shard", "p1", "p2"], "left")
        for c in ("leaves", "saved"):
            both = both.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).drop(f"more_{c}")
    summed = both.select("shard", "slot", "p1", "p2", "parent_slot", "depth", "g_low", "own", "leaves", "saved").groupBy("shard").applyInPandas(lambda nodes: accumulated(nodes, segment), "p1 long, p2 long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long")
    sums = summed.groupBy("p1", "p2").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.max("parent_conv_id").alias("parent_conv_id"))
    heads = both.where("own").select("p1", "p2", F.col("g_low").alias("conv_id"), "depth", F.col("g_n").alias("n_convs"))
    ends = lists_of_members(marked.groupBy("conv_id").agg(F.bit_xor("m1").alias("p1"), F.bit_xor("m2").alias("p2")))
    out = heads.join(sums.hint("merge"), ["p1", "p2"]).join(ends.hint("merge"), ["p1", "p2"], "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
