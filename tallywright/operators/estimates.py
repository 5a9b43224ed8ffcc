"""Estimates over a respondents table: all groups in one aggregate, then arithmetic on a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions.stats import SUPPRESS, base_flags, wilson

from .filters import Filter, Study

ALL = "All observed respondents"


def counts(df: DataFrame, base: Column, selected: Column, groups: dict[str, Filter] | None, among: Filter | None = None) -> DataFrame:
    """(grp, n, k) for each group, from one scan."""
    groups = groups or {ALL: Filter(F.lit(True), F.lit(True))}
    inside = F.coalesce(base, F.lit(False)) & (among.mask if among else F.lit(True))
    hit = inside & F.coalesce(selected, F.lit(False))
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k")) for i, g in enumerate(groups)]))
    return df.agg(*[a for i, g in enumerate(groups.values()) for a in (F.count_if(inside & g.mask).alias(f"n{i}"), F.count_if(hit & g.mask).alias(f"k{i}"))]).select(rows)


def shares(counted: DataFrame) -> DataFrame:
    """Share, Wilson interval and flags of (.., n, k) rows; values of bases under ten are suppressed."""
    lo, hi = wilson(F.col("k"), F.col("n"))
    shown = lambda c: F.when(F.col("n") >= SUPPRESS, c)
    return counted.withColumns({"value": shown(F.col("k") / F.col("n")), "lo": shown(lo), "hi": shown(hi), "flags": base_flags(F.col("n"), F.col("k")), "numerator": shown(F.col("k"))}).drop("k")


def proportion(df: DataFrame, study: Study, v: str, value=True, by: dict[str, Filter] | None = None, among: Filter | None = None) -> DataFrame:
    f = study.where(v, [value])
    return shares(counts(df, f.universe, f.mask, by, among))


def top_box(df: DataFrame, study: Study, v: str, k: int = 2, by: dict[str, Filter] | None = None, among: Filter | None = None) -> DataFrame:
    """The share of the last k categories of a scale, among ranked answers."""
    return shares(counts(df, study.ordered_base(v), F.col(v).isin(study.scales[v][-k:]), by, among))


def distribution(df: DataFrame, study: Study, v: str, group: str) -> DataFrame:
    """(grp, answer, n, ...): every category of an item in every group, also those that nobody chose."""
    base = df.where(study.base(v) & study.base(group)).groupBy(F.col(group).alias("grp"), F.col(v).alias("answer")).agg(F.count(F.lit(1)).alias("k"))
    total = base.groupBy("grp").agg(F.sum("k").alias("n"))
    answers = [x for x in study.values[v] if x != "Prefer not to say"]
    grid = total.withColumn("answer", F.explode(F.array(*map(F.lit, answers))))
    return shares(grid.join(base.hint("merge"), ["grp", "answer"], "left").select("grp", "answer", "n", F.coalesce("k", F.lit(0)).alias("k")))


def rank_options(df: DataFrame, study: Study, block: str, by: dict[str, Filter], top: int | None = None) -> DataFrame:
    """Checkbox options ranked by share inside each group, from one scan: least rank for ties, suppressed last without a rank."""
    options = study.blocks[block]
    base = F.coalesce(study.base(options[0]), F.lit(False))  # the base of a block is that of each option
    aggs = [a for i, g in enumerate(by.values()) for a in (F.count_if(base & g.mask).alias(f"n{i}"), *[F.count_if(base & F.coalesce(F.col(c), F.lit(False)) & g.mask).alias(f"k{i}_{j}") for j, c in enumerate(options)])]
    cells = [F.struct(F.lit(g).alias("grp"), F.lit(c).alias("option"), F.col(f"n{i}").alias("n"), F.col(f"k{i}_{j}").alias("k")) for i, g in enumerate(by) for j, c in enumerate(options)]
    rows = shares(df.agg(*aggs).select(F.inline(F.array(*cells))))
    rows = rows.withColumn("position", F.when(F.col("value").isNotNull(), F.rank().over(W.partitionBy("grp", F.col("value").isNull()).orderBy(F.desc("value")))))
    return rows if top is None else rows.where(F.row_number().over(W.partitionBy("grp").orderBy(F.col("position").asc_nulls_last(), "option")) <= top)


def score(study: Study, v: str) -> Column:
    """The position of an answer on its scale, from 1."""
    return F.element_at(F.create_map(*[F.lit(x) for i, a in enumerate(study.scales[v], 1) for x in (a, i)]), F.col(v))


def mean_scores(df: DataFrame, study: Study, v: str, group: str) -> DataFrame:
    """(grp, n, mean, sd): sufficient statistics of the position on a scale."""
    y = score(study, v)
    return df.where(study.ordered_base(v) & study.base(group)).groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))


def fingerprint(key: Column) -> Column:
    """An order-free fingerprint of a set of keys: the exclusive or of 60 bits of their SHA-256."""
    return F.bit_xor(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("long"))


def inventory(df: DataFrame, measures: list[str], bindings: list[str], key: str) -> DataFrame:
    """(variable, answer, grouping, grp, n, k): every measure by every grouping from one scan, unpivoted on both sides."""
    pairs = F.array(*[F.struct(F.lit(m).alias("variable"), F.col(m).alias("answer"), F.lit(b).alias("grouping"), F.col(b).alias("grp")) for m in measures for b in bindings if m != b])
    cells = df.select(F.inline(pairs)).where("answer is not null and grp is not null and answer <> 'Prefer not to say' and grp <> 'Prefer not to say'").groupBy("variable", "answer", "grouping", "grp").agg(F.count(F.lit(1)).alias("k"))
    return cells.withColumn("n", F.sum("k").over(W.partitionBy("variable", "grouping", "grp")))


def traces(df: DataFrame, study: Study, v: str, group: str, key: str) -> DataFrame:
    """(estimate, grp, n_group, group_print, n_base, base_print): who is in each group of an estimate, and in its base."""
    base = study.base(v)
    each = df.where(study.base(group)).withColumns({"grp": F.col(group), "own": F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("long"), "based": F.coalesce(base, F.lit(False))})
    return each.groupBy("grp").agg(F.count(F.lit(1)).alias("n_group"), F.bit_xor("own").alias("group_print"), F.count_if("based").alias("n_base"), F.bit_xor(F.when(F.col("based"), F.col("own"))).alias("base_print")).withColumn("estimate", F.lit(v))
