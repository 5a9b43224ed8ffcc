"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions


def digests(docs: DataFrame, nodes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, SHA-256 and byte length of its text, and the run (folded input partition) it lies in."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.pmod(F.spark_partition_id(), F.lit(nodes)).alias("run"),
    )


def tree_merge(runs: DataFrame, nodes: int, arity: int, keep: str = "max") -> DataFrame:
    """Merges runs of (run, digest, n_bytes, best, copies) into one row per digest.

    Round r is a binomial exchange among the arity nodes that differ in digit r only: a row moves to the
    member of its group that owns digit r of the digest, and each node merges the runs it receives in the order of
    (digest, length), keeping the best identifier and adding the copies. After log_arity(nodes) rounds every digest is on one
    node, no node holds more than its share of digests, and a digest has at most arity rows per merge however
    many copies it has.

    The identifier is kept within a struct, for which Spark has no hash table in place: it sorts what a node has
    received and merges neighbours (SortAggregate), so each round reads and leaves sorted runs.
    """
    best = F.max if keep == "max" else F.min
    held = F.struct((F.col("best").isNotNull() if keep == "max" else F.col("best").isNull()).alias("rank"), "best")  # null loses
    owner = F.pmod(F.xxhash64("digest"), F.lit(nodes)).cast("int")
    merged, step = runs.withColumnRenamed("run", "node").withColumn("best", held), 1
    while step < nodes:
        digit = lambda c, s=step: F.pmod(F.floor(c / F.lit(s)), F.lit(arity))
        moved = (F.col("node") + (digit(owner) - digit(F.col("node"))) * F.lit(step)).cast("int")
        merged = merged.withColumn("node", moved).repartition("node").groupBy("node", "digest", "n_bytes").agg(best("best").alias("best"), F.sum("copies").alias("copies"))
        step *= arity
    return merged.select("digest", "n_bytes", F.col("best.best").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", arity: int = 8) -> DataFrame:
    """Marks the copies of every text; one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The identifier may be of any type that can be ordered, also a struct. Two texts are equal when SHA-256 and byte length are both equal. keep: which identifier stays, "max" or
    "min". Null text counts as empty. A null identifier never beats another one; a group of null identifiers
    alone has keep_id null and all of them kept. Rows that repeat one identifier with one text are the same
    document and share its verdict. Other columns are ignored. An empty table gives an empty result.

    The verdict goes back down the tree (digest, then run and digest, then rows), so a text with a third of
    all rows is spread over as many tasks as it has runs.
    """
    nodes = arity
    while nodes < shuffle_partitions(docs.sparkSession):
        nodes *= arity
    rows = materialize(digests(docs, nodes, id_col, text_col), "digests")
    best = F.max if keep == "max" else F.min  # both pass over null
    local = rows.groupBy("run", "digest", "n_bytes").agg(best("doc_id").alias("best"), F.count(F.lit(1)).alias("copies"))
    verdict = tree_merge(local, nodes, arity, keep)
    by_run = local.select("run", "digest", "n_bytes").join(verdict.hint("merge"), ["digest", "n_bytes"])
    return rows.join(by_run.hint("merge"), ["run", "digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
