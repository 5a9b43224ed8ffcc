"""Shards of near equal bytes by histogram sort (DataFrame functions only)."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Bits of each part of a key; a first probe cuts a part into 2^FIRST ranges, a later one each open range into 2^NEXT.
BITS, FIRST, NEXT = 60, 12, 8
PARTS = ("k1", "k2", "k3")


@dataclass(frozen=True)
class Range:
    """The keys whose parts before `part` are `fixed` and whose next part begins with the `bits` bits of `prefix`."""

    part: int = 0
    fixed: tuple[int, ...] = ()
    prefix: int = 0
    bits: int = 0

    def edge(self, at: int) -> tuple[int, ...]:
        """The least key from prefix `at` on."""
        return (*self.fixed, at << (BITS - self.bits), 0, 0)[:3]


@dataclass(frozen=True)
class Splitter:
    """Where a piece begins: the rows below the key, and what they hold."""

    key: tuple[int, ...]
    size: int
    rows: int


def digits(value: Column) -> Column:
    """The first 60 bits of the MD5 of a string or binary column."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def counted(rows: DataFrame, ranges: list[Range]) -> dict[Range, list[tuple[int, int, int, int, int]]]:
    """What lies in each cut of the ranges: (prefix, bytes, rows, least and greatest value of the part), by prefix.

    The ranges share part and bits. One job counts all partitions; its result has a row for each cut, so it is bounded by
    the number of splitters, not by the data.
    """
    part, bits = ranges[0].part, ranges[0].bits
    more = bits + (NEXT if bits else FIRST)
    at = F.shiftright(PARTS[part], BITS - more)
    if bits or part:
        names = [*PARTS[:part], "prefix"]
        these = rows.sparkSession.createDataFrame([(*r.fixed, r.prefix, i) for i, r in enumerate(ranges)], ", ".join(f"{n} long" for n in names) + ", range int")
        rows = rows.withColumn("prefix", F.shiftright(PARTS[part], BITS - bits) if bits else F.lit(0).cast("long")).join(these.hint("broadcast"), names)  # a row for each splitter at most
    else:
        rows = rows.withColumn("range", F.lit(0))
    out = defaultdict(list)
    for r in rows.groupBy("range", at.alias("at")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.min(PARTS[part]).alias("lo"), F.max(PARTS[part]).alias("hi")).collect():
        out[ranges[r.range]].append((r["at"], r["size"], r["rows"], r["lo"], r["hi"]))
    return {r: sorted(cuts) for r, cuts in out.items()}


def splitters(rows: DataFrame, targets: list[tuple[int, int]]) -> list[Splitter]:
    """For each target (bytes, tolerance) a key with nearly so many bytes below it.

    rows: (k1, k2, k3, size). A round counts the bytes below all candidate keys of the open ranges. A target is met by the nearer
    edge of the cut that it falls into, if that edge is within the tolerance; else the cut becomes its open range. A cut
    with one value goes on to the next part of the key, and a single key gives its nearer edge.
    """
    found: dict[int, Splitter] = {}
    open_ = {Range(): [(i, 0, 0) for i in range(len(targets))]}  # target, and the bytes and rows below the range
    while open_:
        left: dict[Range, list] = defaultdict(list)
        for level in {(r.part, r.bits) for r in open_}:
            level_ranges = [r for r in open_ if (r.part, r.bits) == level]
            for r, cuts in counted(rows, level_ranges).items():
                more = r.bits + (NEXT if r.bits else FIRST)
                for i, size, n in open_[r]:
                    target, tolerance = targets[i]
                    for at, s, k, lo, hi in cuts:
                        if target < size + s or at == cuts[-1][0]:
                            break
                        size, n = size + s, n + k
                    cut = Range(r.part, r.fixed, at, more)
                    low, high = Splitter(cut.edge(at), size, n), Splitter(cut.edge(at + 1), size + s, n + k)
                    best = min(low, high, key=lambda x: abs(x.size - target))
                    single = lo == hi and r.part == len(PARTS) - 1
                    if abs(best.size - target) <= tolerance or single:
                        found[i] = best
                    elif lo == hi:
                        left[Range(r.part + 1, (*r.fixed, lo))].append((i, size, n))
                    else:
                        left[cut].append((i, size, n))
        open_ = left
    return [found[i] for i in range(len(targets))]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, pieces: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deals documents into shards of near equal bytes; one row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text and one; a null text has none and the CRC of the empty text. Documents are sorted by the
    digest of the text, then that of the identifier. A shard begins within tolerance (a part of an even share) of its
    place, between two different texts if one such place is near enough, else between two copies of one text, and at the nearest document
    if none is (documents longer than the tolerance). So copies share a shard where the law lets them, and a text with a third of all bytes fills
    several. slot is the place in the shard, without gaps from 0. Rows that share identifier and text are told apart by
    a number of their own. grown_shard is null. carry names further columns to take along. An empty table gives an empty result.

    Only keys and sizes are sorted: the bytes and rows below candidate keys are counted in rounds, and then each row goes
    to its piece of a shard in one exchange. A piece's first slot is known from the counts, so a shard is no single task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [digits(text).alias("k1"), digits(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("k2"), F.monotonically_increasing_id().alias("k3")]
    taken = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keys, *taken), "keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = pieces or min(128, max(8, -(-n // (shards * 1_000_000))))
    many = shards * pieces
    share = total / shards
    targets = [(total * i // many, int(share * tolerance) if i % pieces == 0 else int(share / pieces / 4)) for i in range(1, many)]
    begins = [Splitter((0, 0, 0), 0, 0), *(splitters(rows, targets) if n else [])]
    by_bucket = defaultdict(list)
    for i, s in enumerate(begins):
        by_bucket[s.key[0] >> (BITS - FIRST)].append(s)
    table, below = [], 0
    for b in range(1 << FIRST):
        table.append((b, below, [s.key for s in sorted(by_bucket[b], key=lambda s: s.key)]))
        below += len(by_bucket[b])
    spark = docs.sparkSession
    place = spark.createDataFrame(table, "bucket long, below int, inside array<struct<k1: long, k2: long, k3: long>>")
    order = sorted(range(len(begins)), key=lambda i: begins[i].key)
    ends = [begins[i * pieces].key for i in range(1, shards)] if n else []
    first = []
    for rank, i in enumerate(order):  # pieces by the order of their keys
        mine = sum(k <= begins[i].key for k in ends)
        first.append((rank, mine, begins[i].rows - (begins[mine * pieces].rows if mine else 0)))
    offset = spark.createDataFrame(first, "piece int, shard int, first long")
    # both tables have a bound: the ranges of a first probe, and the pieces
    key = F.struct(*PARTS)
    dealt = rows.withColumn("bucket", F.shiftright("k1", BITS - FIRST)).join(place.hint("broadcast"), "bucket")
    dealt = dealt.withColumn("piece", (F.col("below") + F.size(F.filter("inside", lambda s: s <= key)) - 1).cast("int")).drop("bucket", "below", "inside")
    nth = F.row_number().over(W.partitionBy("piece").orderBy(*PARTS))
    out = dealt.withColumn("nth", nth).join(offset.hint("broadcast"), "piece")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", **more) -> None:
    """Writes the documents with their shard and slot, a folder for each shard; files hold runs of slots.

    Columns of the documents that are named like those of the result are left out.
    """
    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    shard(docs, shards, id_col, text_col, carry=tuple(c for c in docs.columns if c not in own), **more).write.partitionBy("shard").parquet(path)
