"""Contrasts on sufficient statistics: respondents are grouped once, tests read a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions.stats import SUPPRESS, Z, check_expectation, cohens_h, contrast_label, holm, holm_label, newcombe, p_chi2, p_normal, pooled_z, threshold_test, two_shares_test


def expected(expect: str | None | Column) -> Column:
    """What is expected, as a column; a plain value is checked."""
    if isinstance(expect, Column):
        return expect
    check_expectation(expect)
    return F.lit(expect)


def beside(df: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """Each row of df with the sums of its key; without a key, with the one row there is."""
    return df.join(sums.hint("merge"), by) if by else df.crossJoin(F.broadcast(sums))


def compare(counted: DataFrame, expect: str | None | Column = None, by: list[str] | None = None) -> DataFrame:
    """Every pair a < b of the groups of (grp, n, k): difference a - b, interval, z, p and its method, effect and label.

    A pair with a base under ten has none of these, and the label "unavailable" if something was expected of it. by: columns of counted inside which
    groups are paired.
    """
    by = by or []
    label = expected(expect)
    side = lambda x: counted.select(*by, F.col("grp").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"))
    # a row for each group of an estimate, which its codebook bounds
    pairs = side("a").join(side("b").hint("merge"), by).where("a < b") if by else side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b"))
    shown = (F.col("na") >= SUPPRESS) & (F.col("nb") >= SUPPRESS)
    ka, na, kb, nb = (F.col(c) for c in ("ka", "na", "kb", "nb"))
    pa, pb = ka / F.nullif(na, F.lit(0)), kb / F.nullif(nb, F.lit(0))
    lo, hi = newcombe(ka, na, kb, nb)
    p, method = two_shares_test(*[F.when(shown, x) for x in (ka, na, kb, nb)])
    out = {"value": pa - pb, "lo": lo, "hi": hi, "z": pooled_z(ka, na, kb, nb), "h": cohens_h(pa, pb), "p": p, "test": method}
    pairs = pairs.withColumns({c: F.when(shown, x) for c, x in out.items()})
    return pairs.withColumn("label", contrast_label(F.col("lo"), F.col("hi"), label))


def against(counted: DataFrame, threshold: float | Column, expect: str | None | Column = None) -> DataFrame:
    """Each group of (grp, n, k) against a share: value, lo, hi (all less the threshold), p, test, label."""
    label = expected(expect)
    if not isinstance(threshold, Column):
        if not 0 < threshold < 1:
            raise ValueError("WrongThreshold: a share strictly between 0 and 1")
        threshold = F.lit(float(threshold))
    shown = F.col("n") >= SUPPRESS
    lo, hi, p, test = threshold_test(F.when(shown, F.col("k")), F.when(shown, F.col("n")), threshold)
    out = {"value": F.col("k") / F.col("n") - threshold, "lo": lo, "hi": hi, "p": p, "test": test}
    found = counted.withColumns({c: F.when(shown, x) for c, x in out.items()})
    return found.withColumn("label", contrast_label(F.col("lo"), F.col("hi"), label))


def pack(contrasts: DataFrame, pack: list[str], key: list[str]) -> DataFrame:
    """contrasts (p, value, expect, value_scale) with p_holm, direction, label_holm and the number of tests of their pack.

    Holm covers every test of the pack, whatever the part of the claim; the direction is the effect's sign on the scale
    whose null is 0, and null for a measure that has none.
    """
    sign = F.when(F.col("value_scale") == "odds_ratio", F.signum(F.ln("value"))).when(F.col("value_scale") == "cramers_v", F.lit(None)).otherwise(F.signum("value")).cast("int")
    found = contrasts.withColumn("p_holm", holm(F.col("p"), pack, key)).withColumn("direction", sign)
    return found.withColumns({"label_holm": holm_label(F.col("direction"), F.col("p_holm"), F.col("expect")), "test_count": F.count("p").over(W.partitionBy(*pack))})


def associations(cells: DataFrame) -> DataFrame:
    """(x, y, n, chi2, df, v, p) of each pair of variables, from cells (x, y, u, v, k) of their answers; a base under ten has no statistic.

    Chi-square with Cramer's V; sums over an empty cell are those of the cell's absence, as its expectation is in the margins.
    """
    by = W.partitionBy("x", "y")
    expected = F.sum("k").over(W.partitionBy("x", "y", "u")) * F.sum("k").over(W.partitionBy("x", "y", "v")) / F.sum("k").over(by)
    one = cells.withColumn("e", expected).groupBy("x", "y").agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("k") / F.col("e")) - F.sum("k")).alias("chi2"), F.count_distinct("u").alias("r"), F.count_distinct("v").alias("c"))
    shown = lambda c: F.when(F.col("n") >= SUPPRESS, c)
    df = ((F.col("r") - 1) * (F.col("c") - 1)).alias("df")
    found = one.select("x", "y", "n", shown(F.col("chi2")).alias("chi2"), df, shown(F.sqrt(F.col("chi2") / (F.col("n") * F.nullif(F.least("r", "c") - 1, F.lit(0))))).alias("v"))
    return found.withColumn("p", F.when(F.col("df") > 0, p_chi2("chi2", F.col("df").cast("double"))))


def association(cells: DataFrame) -> DataFrame:
    """One row (n, chi2, df, v, p) from the cells (x, y, k) of one pair of variables."""
    named = cells.select(F.lit("x").alias("x"), F.lit("y").alias("y"), F.col("x").alias("u"), F.col("y").alias("v"), "k")
    return associations(named).drop("x", "y")


def shown_cells(cells: DataFrame) -> DataFrame:
    """The table (x, y, n) behind an association, with cells under ten hidden, its base, and whether that is tested."""
    base = F.sum("n").over(W.partitionBy(F.lit(1)))  # a row for each cell
    return cells.select("x", "y", F.when(F.col("n") >= SUPPRESS, F.col("n")).alias("n"), base.alias("base"), (base >= SUPPRESS).alias("tested"))


def stratum_bases(df: DataFrame, first: Column, covered: Column, controls: list[str]) -> DataFrame:
    """(part, strata, na, nb): respondents of two groups in strata that are kept and dropped, and those with a control missing.

    first: who is in the first group, all others being in the second. A stratum is a tuple, so no label runs into another.
    """
    seen = df.withColumns({"first": first, "covered": covered})
    each = seen.groupBy("covered", F.when(F.col("covered"), F.struct(*controls)).alias("stratum")).agg(F.count_if("first").alias("na"), F.count_if(~F.col("first")).alias("nb"))
    kept = (F.col("na") + F.col("nb") >= SUPPRESS) & (F.col("na") > 0) & (F.col("nb") > 0)
    part = F.when(~F.col("covered"), "missing_controls").when(kept, "kept").otherwise("dropped")
    return each.groupBy(part.alias("part")).agg(F.count_if("covered").alias("strata"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def spearman(cells: DataFrame) -> DataFrame:
    """Spearman's rho with midranks from the contingency table (x, y, k)."""

    def mid(c: str):
        upto = F.sum("k").over(W.orderBy(c).rangeBetween(W.unboundedPreceding, 0))  # a few cells
        return upto - (F.sum("k").over(W.partitionBy(c)) - 1) / 2.0

    ranked = cells.select("k", mid("x").alias("rx"), mid("y").alias("ry"))
    n, s = F.sum("k"), lambda e: F.sum(F.col("k") * e)
    one = ranked.agg(n.alias("n"), s(F.col("rx")).alias("sx"), s(F.col("ry")).alias("sy"), s(F.col("rx") * F.col("ry")).alias("sxy"), s(F.col("rx") * F.col("rx")).alias("sxx"), s(F.col("ry") * F.col("ry")).alias("syy"))
    return one.select("n", ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt((F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n")))).alias("rho"))


def trend(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Slope over positions with its HC3 error, interval and p, exactly, from (position, n, s, ss) with sums of y and y squared; by: a slope for each key."""
    by, x, n = by or [], F.col("position"), F.col("n")
    j = beside(sums, sums.groupBy(*by).agg(F.sum("n").alias("all_n"), (F.sum(n * x) / F.sum("n")).alias("mx"), (F.sum("s") / F.sum("n")).alias("my")), by)
    j = beside(j, j.groupBy(*by).agg(F.sum(n * (x - F.col("mx")) ** 2).alias("sxx"), F.sum((x - F.col("mx")) * F.col("s")).alias("sxy")), by).withColumn("slope", F.col("sxy") / F.col("sxx"))
    fit = F.col("my") + F.col("slope") * (x - F.col("mx"))
    resid2 = F.col("ss") - 2 * fit * F.col("s") + n * fit * fit
    leverage = 1 / F.col("all_n") + (x - F.col("mx")) ** 2 / F.col("sxx")
    meat = F.sum((x - F.col("mx")) ** 2 * resid2 / (1 - leverage) ** 2)
    found = j.groupBy(*by).agg(F.max("all_n").alias("n"), F.max("slope").alias("slope"), (F.sqrt(meat) / F.max("sxx")).alias("se"))
    return found.withColumns({"lo": F.col("slope") - Z * F.col("se"), "hi": F.col("slope") + Z * F.col("se"), "p": p_normal(F.col("slope") / F.nullif(F.col("se"), F.lit(0.0)))})


def mantel_haenszel(strata: DataFrame, expect: str | None | Column = None, by: list[str] | None = None) -> DataFrame:
    """The pooled odds ratio of 2x2 strata (a, b, c, d): interval, p (Cochran-Mantel-Haenszel), label, and the crude ratio.

    Strata with an empty side or under ten respondents are dropped and counted; sparse tells of an expected cell under five
    in a stratum that is used. A pooled ratio of zero or infinity has no interval and the label "unavailable". by: a ratio for each key.
    """
    by, wanted = by or [], expected(expect)
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")  # products of four counts leave 64 bits
    n = a + b + c + d
    used = (n >= SUPPRESS) & (a + b > 0) & (c + d > 0)
    r, s = a * d / n, b * c / n
    p, q = (a + d) / n, (b + c) / n
    only = lambda x: F.sum(F.when(used, x))
    spread = (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))
    thin = F.least(a + b, c + d) * F.least(a + c, b + d) / n < 5
    one = strata.groupBy(*by).agg(only(r).alias("r"), only(s).alias("s"), only(p * r).alias("pr"), only(p * s + q * r).alias("ps"), only(q * s).alias("qs"), only(a - (a + b) * (a + c) / n).alias("gap"), only(spread).alias("spread"), F.count_if(used).alias("strata"), F.count_if(~used).alias("dropped"), F.bool_or(used & thin).alias("sparse"), *[only(x).alias(name) for name, x in zip("abcd", (a, b, c, d), strict=True)])
    one = one.withColumn("odds", F.when(F.col("r") > 0, F.col("r") / F.nullif(F.col("s"), F.lit(0.0))))
    some_r, some_s = F.nullif(F.col("r"), F.lit(0.0)), F.nullif(F.col("s"), F.lit(0.0))
    se = F.sqrt(F.col("pr") / (2 * some_r * some_r) + F.col("ps") / (2 * some_r * some_s) + F.col("qs") / (2 * some_s * some_s))
    lo, hi = F.ln("odds") - Z * se, F.ln("odds") + Z * se
    cmh = F.when(F.col("odds").isNotNull(), F.col("gap") / F.nullif(F.sqrt("spread"), F.lit(0.0)))  # its square is the statistic
    crude = F.col("a") * F.col("d") / F.nullif(F.col("b") * F.col("c"), F.lit(0.0))
    return one.select(*by, "strata", "dropped", "sparse", F.col("odds").alias("odds_ratio"), F.exp(lo).alias("lo"), F.exp(hi).alias("hi"), p_normal(cmh).alias("p"), contrast_label(lo, hi, wanted).alias("label"), crude.alias("crude"))


def breslow_day(strata: DataFrame) -> DataFrame:
    """(strata, statistic, df, p): whether the odds ratios of 2x2 strata (a, b, c, d) are equal.

    Each stratum's first cell is expected from its margins and the pooled odds ratio. Strata with an empty margin or under ten respondents are left out.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    used = strata.where((n >= 10) & (a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0))
    pooled = used.agg((F.sum(a * d / n) / F.sum(b * c / n)).alias("r"))
    r, row, col = F.col("r"), a + b, a + c
    mid = d - a + r * (row + col)
    root = F.when(r == 1, row * col / n).otherwise((-mid + F.sqrt(mid * mid + 4 * (1 - r) * r * row * col)) / (2 * (1 - r)))
    e = F.col("e")
    each = used.crossJoin(F.broadcast(pooled)).withColumn("e", root)  # one row
    return each.agg(F.count(F.lit(1)).alias("strata"), F.sum((a - e) ** 2 * (1 / e + 1 / (row - e) + 1 / (col - e) + 1 / (d - a + e))).alias("statistic")).withColumn("df", F.col("strata") - 1).withColumn("p", F.when(F.col("df") > 0, p_chi2("statistic", F.col("df").cast("double"))))
