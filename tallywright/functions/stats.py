"""Intervals, effects and labels from counts, as column arithmetic; tails of distributions as Arrow functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: The normal quantile of 95 % intervals, the small-base limits, and the answer that is in no base.
Z = 1.959963984540054
SUPPRESS, SMALL, SPARSE = 10, 30, 10
REFUSAL = "Prefer not to say"


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson 95 % interval of k of n; null for n = 0."""
    p, z2 = k / F.nullif(n, F.lit(0)), F.lit(Z * Z)
    mid, half = p + z2 / (2 * n), F.lit(Z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def newcombe(ka: Column, na: Column, kb: Column, nb: Column) -> tuple[Column, Column]:
    """The hybrid-score 95 % interval of the difference of two shares."""
    pa, pb = ka / F.nullif(na, F.lit(0)), kb / F.nullif(nb, F.lit(0))
    (la, ua), (lb, ub) = wilson(ka, na), wilson(kb, nb)
    return pa - pb - F.sqrt((pa - la) ** 2 + (ub - pb) ** 2), pa - pb + F.sqrt((ua - pa) ** 2 + (pb - lb) ** 2)


def cohens_h(pa: Column, pb: Column) -> Column:
    return 2 * F.asin(F.sqrt(pa)) - 2 * F.asin(F.sqrt(pb))


def pooled_z(ka: Column, na: Column, kb: Column, nb: Column) -> Column:
    """The two-sample z of shares with the pooled variance; null without variation."""
    p = (ka + kb) / (na + nb)
    return (ka / na - kb / nb) / F.nullif(F.sqrt(p * (1 - p) * (1 / na + 1 / nb)), F.lit(0.0))


def base_flags(n: Column, k: Column) -> Column:
    """Flags of a base: small, suppressed, empty, sparse."""
    flags = F.array(F.when(n < SMALL, "small_n"), F.when((n > 0) & (n < SUPPRESS), "suppressed"), F.when(n == 0, "empty_segment"), F.when((n >= SUPPRESS) & ((k < SPARSE) | (n - k < SPARSE)), "sparse_count"))
    return F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",")


#: What a contrast may be expected to be; null for nothing.
EXPECTED, ALPHA = (">", "<", "!="), 0.05


def check_expectation(expect: str | None) -> None:
    if expect is not None and expect not in EXPECTED:
        raise ValueError(f"WrongExpectation: one of {', '.join(EXPECTED)} or none")


def contrast_label(lo: Column, hi: Column, expect: Column) -> Column:
    """The label of an interval against a declared direction; one that touches 0 shows no clear difference."""
    agrees = (expect == "!=") | ((lo > 0) == (expect == ">"))
    return F.when(expect.isNull(), "not_tested").when(lo.isNull(), "unavailable").when((lo <= 0) & (hi >= 0), "no_clear_difference").when(agrees, "consistent").otherwise("inconsistent")


def holm_label(direction: Column, p_holm: Column, expect: Column) -> Column:
    """The label of an adjusted p and the sign of an effect (null: it has none) against a declared direction."""
    sign = F.coalesce(direction, F.lit(0))
    open_ = (p_holm >= ALPHA) | ((expect != "!=") & (sign == 0))
    agrees = (expect == "!=") | ((sign > 0) == (expect == ">"))
    return F.when(p_holm.isNull(), "unavailable").when(expect.isNull(), "not_tested").when(open_, "no_clear_difference").when(agrees, "consistent").otherwise("inconsistent")


def invalid_counts(k: Column, n: Column) -> Column:
    """Whether k of n can't be counts of a sample: 0 <= k <= n and n > 0 must hold."""
    return k.isNull() | n.isNull() | (n <= 0) | (k < 0) | (k > n)


def least_expected(ka: Column, na: Column, kb: Column, nb: Column) -> Column:
    """The least expected cell of the 2x2 table of two shares."""
    total, hit = na + nb, ka + kb
    return F.least(na, nb) * F.least(hit, total - hit) / total


def two_shares_test(ka: Column, na: Column, kb: Column, nb: Column) -> tuple[Column, Column]:
    """p and its method: the pooled z, or Fisher's exact test if an expected cell is under five.

    A Python function runs on all rows, whatever condition stands before it, so others come to it as null: a sparse table of n
    respondents has at most sqrt(5 n) alternatives, any other as many as respondents.
    """
    sparse = least_expected(ka, na, kb, nb) < 5
    p = F.when(sparse, p_fisher(*[F.when(sparse, x) for x in (ka, na - ka, kb, nb - kb)])).otherwise(p_normal(pooled_z(ka, na, kb, nb)))
    return p, F.when(sparse, "fisher_exact").otherwise("pooled_z")


def threshold_test(k: Column, n: Column, t: Column) -> tuple[Column, Column, Column, Column]:
    """Interval of k/n - t, p and method: Wilson and score z, or Clopper-Pearson and the exact test if n t or n (1 - t) is under five.

    The interval and the p are of one family, so the interval leaves 0 out exactly where p is under 0.05.
    """
    exact = F.least(n * t, n * (1 - t)) < 5
    ke, ne = F.when(exact, k), F.when(exact, n)  # the exact functions run on all rows
    (wlo, whi), both = wilson(k, n), clopper_pearson(ke, ne)
    z = (k / n - t) / F.sqrt(t * (1 - t) / n)
    pick = lambda x, y: F.when(exact, x).otherwise(y)
    return pick(both["lo"], wlo) - t, pick(both["hi"], whi) - t, pick(p_binomial(ke, ne, t), p_normal(z)), pick(F.lit("exact_binomial"), F.lit("score_z"))


def holm(p: Column, pack: list[str], key: list[str]) -> Column:
    """The Holm adjustment of p over each pack, nulls left out."""
    by = W.partitionBy(*pack, p.isNull()).orderBy(p, *key)
    m = F.count(p).over(W.partitionBy(*pack))
    step = (m - F.row_number().over(by) + 1) * p
    return F.when(p.isNotNull(), F.least(F.lit(1.0), F.max(step).over(by.rowsBetween(W.unboundedPreceding, 0))))


def _beta_cf(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + e * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + e / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The upper quantile of t for a one-sided p below a half, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) / 2 > p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    """The upper tail of chi-square by series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def fisher(a: int, b: int, c: int, d: int) -> float:
    """The two-sided exact p of a 2x2 table: the tables no more likely than this one."""
    r, s, k = a + b, c + d, a + c
    log = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(s + 1) - math.lgamma(k - x + 1) - math.lgamma(s - k + x + 1)
    each = [log(x) for x in range(max(0, k - s), min(r, k) + 1)]
    top, own = max(each), log(a)
    return min(1.0, sum(math.exp(x - top) for x in each if x <= own + 1e-7) / sum(math.exp(x - top) for x in each))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """The central exact p: twice the smaller tail."""
    low = beta_cdf(n - k, k + 1, 1 - p) if k < n else 1.0
    high = beta_cdf(k, n - k + 1, p) if k > 0 else 1.0
    return min(1.0, 2 * min(low, high))


def beta_quantile(q: float, a: float, b: float) -> float:
    """The quantile of a beta distribution, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def _series(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in xs) else f(*xs) for xs in zip(*cols, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    return _series(lambda x: math.erfc(abs(x) / math.sqrt(2)), z)


@F.pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def q_t(df: pd.Series) -> pd.Series:
    return _series(lambda d: t_quantile(0.025, d), df)


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def p_fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _series(lambda *x: fisher(*map(int, x)), a, b, c, d)


@F.pandas_udf(DoubleType())
def p_binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _series(lambda a, b, c: binomial_two_sided(int(a), int(b), c), k, n, p)


@F.pandas_udf(StructType([StructField("lo", DoubleType()), StructField("hi", DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The exact 95 % interval of k of n."""

    def one(k: int, n: int) -> tuple[float, float]:
        return (beta_quantile(0.025, k, n - k + 1) if k else 0.0), (beta_quantile(0.975, k + 1, n - k) if k < n else 1.0)

    return pd.DataFrame([(None, None) if pd.isna(a) or pd.isna(b) or not b else one(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"], dtype="float64")
