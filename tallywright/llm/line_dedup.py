"""Line dedup by a deletion-neighbourhood join over words (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, words

ID = ["doc_id", "line"]


def halves(w: Column) -> Column:
    """The parts of a line that a one-word edit may leave untouched.

    A line of n words plays two roles: "own" in the layout of n words, and "short" in the layout of n + 1
    words, as what is left when a word of a longer line is deleted. In either layout the edit lies in one
    half, so the other half is equal; side names the half that may differ, outside hashes the equal one.
    Rows: (role, side, outside, start, size), start and size being the differing part of this line.
    """
    n = F.size(w)

    def row(role: str, side: int) -> Column:
        layout = n if role == "own" else n + 1
        first = F.floor(layout / 2).cast("int")  # words in the first half of the layout
        lost = 0 if role == "own" else 1
        start, size = (F.lit(1), first - lost) if side == 0 else (first + 1, n - first)
        rest = F.slice(w, first + 1 - lost, n - first + lost) if side == 0 else F.slice(w, F.lit(1), first)
        return F.struct(F.lit(role).alias("role"), F.lit(side).alias("side"), F.xxhash64(layout, F.lit(side), rest).alias("outside"), start.alias("start"), size.alias("size"))

    return F.array(*[row(role, side) for role in ("own", "short") for side in (0, 1)])


def edit_at_most_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one substitution, insertion or deletion."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    n, m = F.size(longer), F.size(shorter)
    at = F.array_position(F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y)), False).cast("int")  # the first difference, 0: none
    tail = lambda x, i, size: F.slice(x, i, F.greatest(F.lit(0), size - i + 1))
    return F.when(at == 0, n == m).when(n == m, tail(longer, at + 1, n) == tail(shorter, at + 1, m)).when(n == m + 1, tail(longer, at + 1, n) == tail(shorter, at, m)).otherwise(F.lit(False))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line, body, digest) of every line; digest is the MD5 of the line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line", "body"))
    return each.withColumn("digest", F.unhex(F.md5(F.col("body").cast("binary"))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = 5, broadcast_rows: int = 100_000) -> DataFrame:
    """Finds every line that an earlier line repeats, exactly or within an edit of one word.

    Lines are what \\n separates; a line without a word is never dropped. Lines are ordered by (doc_id,
    line number, MD5 of the line), so lines of rows that share an identifier, or have none, have an order too, and the
    result doesn't depend on how the rows are dealt. A line is dropped as "exact" if an earlier one is identical, else as "near" if it has
    near_words words or more and an earlier distinct line, of near_words or more too, is at most one
    substituted, inserted or deleted word away. Near links don't chain: what is compared is the text.
    One row per line with a word: doc_id, line, chars, dropped (null, exact or near), earlier_doc, earlier_line.
    Null text has no lines; null identifiers sort first; of rows that repeat an identifier, equal lines at one
    line number are both kept or dropped for the same earlier line. An empty table gives
    an empty result; further columns are ignored.

    Steps: (1) exact copies meet by digest, summed up before the shuffle; (2) distinct lines that share an
    untouched half with another go on; (3) these emit all deletions within the other half as hashed keys,
    kept in linear space by XOR prefix hashes; (4) equal keys are joined to the earliest line of the key, so
    k lines with one key give k rows and not their pairs; (5) the words of the two lines are compared.

    The joins that bring the verdict back to the lines are left sort-merge joins, whose large partitions Spark
    splits, so one line may be a third of all; what is known to have at most broadcast_rows rows is broadcast.
    """
    split = split_lines(docs, id_col, text_col).withColumn("w", words(F.col("body"))).where(F.size("w") > 0)
    lines = materialize(
        split.select(
            *ID,
            "digest",
            F.length("body").alias("chars"),
            F.when(F.size("w") >= near_words, F.transform(halves(F.col("w")), lambda h: F.struct(h["role"], h["outside"]))).alias("halves"),
        ),
        "lines",
    )
    first = materialize(lines.groupBy("digest").agg(F.min(F.struct(*ID, "halves")).alias("v"), F.count(F.lit(1)).alias("n")), "first-lines")
    near = materialize(near_links(docs, first.select("v.*", "digest"), id_col, text_col, broadcast_rows), "near")
    # a line that is the first of its kind and is near none needs no verdict
    copies = first.where("n > 1").select("digest", F.struct("v.doc_id", "v.line").alias("first"))
    known = materialize(copies.join(near.select(F.col("late.digest").alias("digest"), "early").hint("merge"), "digest", "full"), "verdicts")
    marked = lines.select(*ID, "digest", "chars").join(known.hint("broadcast" if known.count() <= broadcast_rows else "merge"), "digest", "left")
    copy = F.col("first").isNotNull() & ~F.struct(*ID).eqNullSafe(F.col("first"))
    return marked.select(
        *ID,
        "chars",
        F.when(copy, F.lit("exact")).when(F.col("early").isNotNull(), F.lit("near")).alias("dropped"),
        F.when(copy, F.col("first.doc_id")).otherwise(F.col("early.doc_id")).alias("earlier_doc"),
        F.when(copy, F.col("first.line")).otherwise(F.col("early.line")).alias("earlier_line"),
    )


def near_links(docs: DataFrame, first: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(late, early): for each distinct line the earliest one that is one word away, if it is earlier; first: (doc_id, line, digest, halves)."""
    key = [*ID, "digest"]
    at = F.struct(*key)
    parts = first.where(F.col("halves").isNotNull()).select(*key, F.inline("halves"))
    shared = parts.groupBy("outside").agg(F.count_if(F.col("role") == "own").alias("own"), F.count(F.lit(1)).alias("all")).where((F.col("own") >= 1) & (F.col("all") >= 2)).select("outside")
    wanted = materialize(parts.join(shared.hint("merge"), "outside", "left_semi").groupBy(*key).agg(F.collect_set("outside").alias("outsides")), "halves")  # at most four
    how = "broadcast" if wanted.count() <= broadcast_rows else "merge"
    ids = wanted.select(F.col("doc_id").alias("d2")).distinct().hint(how)
    # a line's words are read again from its document; the digest tells lines of rows that share an identifier apart
    bodies = split_lines(docs.join(ids, F.col(id_col).eqNullSafe(F.col("d2")), "left_semi"), id_col, text_col)
    again = wanted.select(F.col("doc_id").alias("d3"), F.col("line").alias("l3"), F.col("digest").alias("g3"), "outsides").hint(how)
    same = F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("line") == F.col("l3")) & (F.col("digest") == F.col("g3"))
    bodies = materialize(bodies.join(again, same).select(*key, "outsides", words(F.col("body")).alias("w")).dropDuplicates(key), "near-lines")
    cut = bodies.select(*key, "w", "outsides", F.inline(halves(F.col("w")))).where(F.array_contains("outsides", F.col("outside"))).select(*key, "role", "side", "outside", F.slice("w", F.col("start"), F.col("size")).alias("part"))
    whole = F.aggregate(F.transform("part", lambda x, i: F.xxhash64(x, i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    short = cut.where("role = 'short'").select(at.alias("id"), F.xxhash64("outside", whole).alias("key"))
    line = W.partitionBy(*key, "side")
    upto = line.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    word = cut.where("role = 'own'").select(*key, "side", "outside", F.posexplode("part").alias("i", "x")).select(*key, "side", "outside", "i", F.xxhash64("x", "i").alias("stays"), F.xxhash64("x", F.col("i") - 1).alias("moves"))
    left = F.bit_xor("moves").over(line).bitwiseXOR(F.bit_xor("moves").over(upto)).bitwiseXOR(F.bit_xor("stays").over(upto)).bitwiseXOR(F.col("stays"))
    own = materialize(word.select(at.alias("id"), "i", "outside", left.alias("left")).select("id", "i", F.xxhash64("outside", "left").alias("key")), "deletions")
    swapped = own.groupBy("key", "i").agg(F.min("id").alias("early"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shortest = short.groupBy("key").agg(F.min("id").alias("early"))
    longer = own.groupBy("key").agg(F.min("id").alias("early"))
    links = (
        own.join(swapped.hint("merge"), ["key", "i"]).select(F.col("id").alias("late"), "early")
        .unionByName(own.join(shortest.hint("merge"), "key").select(F.col("id").alias("late"), "early"))
        .unionByName(short.join(longer.hint("merge"), "key").select(F.col("id").alias("late"), "early"))
        .where("early < late")
        .groupBy("late").agg(F.min("early").alias("early"))
    )
    text = bodies.select(at.alias("t"), "w")
    both = links.join(text.select(F.col("t").alias("late"), F.col("w").alias("a")).hint("merge"), "late").join(text.select(F.col("t").alias("early"), F.col("w").alias("b")).hint("merge"), "early")
    return both.where(edit_at_most_one(F.col("a"), F.col("b"))).select("late", "early")


def rebuild(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines of line_dedup taken out of their texts. Rows that share an identifier lose the same line numbers."""
    drops = found.where(F.col("dropped").isNotNull()).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    kept = F.array_join(F.filter(F.split(F.col(f"d.{text_col}"), "\n"), lambda x, i: ~F.array_contains("x.lines", i)), "\n")
    new = F.when(F.col("x.lines").isNull(), F.col(f"d.{text_col}")).otherwise(kept).alias(text_col)
    joined = docs.alias("d").join(drops.alias("x").hint("merge"), F.col(f"d.{id_col}").eqNullSafe(F.col("x.doc_id")), "left")
    return joined.select(*[new if c == text_col else F.col(f"d.{c}") for c in docs.columns])


def by_document(found: DataFrame) -> DataFrame:
    """One row per identifier with a line: how many lines it has, how many were dropped, and a hash of the dropped lines' numbers.

    The hash (exclusive or of XXH64) has one size however many lines go, as rows without an identifier are one group here.
    """
    dropped = F.col("dropped").isNotNull()
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("dropped") == "exact").alias("n_exact"),
        F.count_if(F.col("dropped") == "near").alias("n_near"),
        F.sum(F.when(~dropped, F.col("chars")).otherwise(0)).cast("long").alias("kept_chars"),
        F.coalesce(F.bit_xor(F.when(dropped, F.xxhash64("line"))), F.lit(0)).cast("long").alias("dropped_hash"),
    )
