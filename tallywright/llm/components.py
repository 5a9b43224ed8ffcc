"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tasks that the neighbours of one node are dealt over when the least of them is joined back.
SALTS = 8


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node of its component.

    A step groups by node for the least neighbour (with partial sums before the shuffle) and joins it back on
    node and salt, so a node with very many neighbours is dealt over SALTS tasks. The number of rounds grows
    with the logarithm of the component size. Every round is written to the scratch folder, so a lost executor
    costs one round.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
        """pairs (a, b) with m, the least neighbour of a."""
        dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        return dealt.join(least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).hint("merge"), ["a", "salt"])

    now = materialize(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a > b").distinct(), "edges")
    seen = state(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, least).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "edges")
        before, seen = seen, state(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
