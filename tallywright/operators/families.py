"""Hash-based identities, owners and selections: fixed by keys alone, never by results or by partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.sources.files import shared_folder


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON list of strings; null is the empty string."""
    return F.sha2(F.concat(F.lit('["'), F.concat_ws('", "', *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), F.lit('"]')), 256)


def unit(hashed: Column) -> Column:
    """The first 64 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(hashed, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def owner(hashed: Column, ratios: dict[str, float]) -> Column:
    """The split that owns a hash: cumulated ratios against its unit."""
    out, at = None, 0.0
    for name, share in ratios.items():
        at += share
        test = unit(hashed) < at
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(name)


def fixed_direction(hashed: Column) -> Column:
    """Higher or lower by the parity of the 16th hex digit."""
    return F.when(F.conv(F.substring(hashed, 16, 1), 16, 10).cast("int") % 2 == 0, "higher").otherwise("lower")


def quotas(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, quota): shares of size by largest remainder."""
    each = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(W.partitionBy(F.lit(1)))  # a row for each stratum
    each = each.withColumn("exact", F.lit(size) * F.col("c") / total).withColumn("whole", F.floor("exact"))
    left = F.lit(size) - F.sum("whole").over(W.partitionBy(F.lit(1)))
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), stratum))
    return each.select(stratum, (F.col("whole") + (place <= left).cast("int")).alias("quota"))


def take_by_hash(df: DataFrame, stratum: str, key: str, seed: int, limit: Column, salts: int = 64) -> DataFrame:
    """The first rows of each stratum in the order of the seeded hash of their keys.

    Each of `salts` parts of a stratum is cut to the limit before the parts meet, so a stratum with most of all rows is no single task.
    """
    by = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(salts))
    some = df.withColumns({"_by": by, "_limit": limit, "_part": part}).withColumn("_place", F.row_number().over(W.partitionBy(stratum, "_part").orderBy("_by"))).where(F.col("_place") <= F.col("_limit"))
    return some.withColumn("_place", F.row_number().over(W.partitionBy(stratum).orderBy("_by"))).where(F.col("_place") <= F.col("_limit")).drop("_by", "_limit", "_part", "_place")


def select_disjoint(candidates: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id) of candidates (id, score, core) such that no two share a core.

    Each round takes every candidate that is the best of all that share one of its cores, and drops those that
    share a core with a taken one, until no candidate is left: what isn't taken shares a core with a taken one.
    Every round takes one or more; most_rounds only guards against an error and raises. Every round is
    written to the shared folder, so the next one doesn't repeat it.
    """
    spark = candidates.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "selection")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    left, taken = written(candidates.where("id is not null and core is not null")), None
    for _ in range(most_rounds):
        if taken is not None and left.isEmpty():
            break
        best = left.groupBy("core").agg(F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("best"))
        mine = left.join(best.hint("merge"), "core").groupBy("id").agg(F.bool_and(F.col("best") == F.col("id")).alias("won")).where("won").select("id")
        won = written(left.join(mine.hint("merge"), "id"))
        taken = won if taken is None else taken.unionByName(won)
        hit = left.join(won.select("core").distinct().hint("merge"), "core", "left_semi").select("id").distinct()
        left = written(left.join(hit.hint("merge"), "id", "left_anti"))
    else:
        raise RuntimeError(f"candidates are left after {most_rounds} rounds")
    return taken.select("id").distinct()


def by_study(cards: DataFrame, variable: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(study, answer, a, b, core): the families of each study's cards (study, answer) for its declared pairs of groups."""
    grid = cards.withColumn("pair", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))).select("study", "answer", "pair.a", "pair.b")
    return grid.withColumn("core", digest(F.col("study"), F.lit(variable), F.col("answer"), F.col("a"), F.col("b")))


def plan(owned: DataFrame, executed: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
    """(split, families, executed, selected) of a plan: owned (family, split), executed (family, executed), and how many each split takes.

    Of the executed families of a split the first by seeded hash are selected.
    """
    known = owned.join(executed.hint("merge"), "family", "left").withColumn("executed", F.coalesce("executed", F.lit(False)))
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n)]), F.col("split"))
    taken = take_by_hash(known.where("executed").withColumn("name", F.col("family").cast("string")), "split", "name", seed, limit)
    each = known.groupBy("split").agg(F.count(F.lit(1)).alias("families"), F.count_if("executed").alias("executed"))
    return each.join(taken.groupBy("split").agg(F.count(F.lit(1)).alias("selected")).hint("merge"), "split", "left").select("split", "families", "executed", F.coalesce("selected", F.lit(0)).alias("selected"))
