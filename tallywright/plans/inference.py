"""Queries of tests on counts: p-values, labels, the Holm adjustment over a pack, and comparisons within strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import stats
from tallywright.operators import contrasts, estimates
from tallywright.operators.specs import run_specs

from .details import _DEBT, debts
from .estimation import _BB, _CNT, _SCORE, _THR, WHI, WLO, Z, rounded
from .registry import query
from .study import ORDERS, SQL, respondents

#: Coefficients of a published approximation of erfc (relative error 1.2e-7), for the SQL only; fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def sql_erfc(x: str) -> str:
    t = f"(1 / (1 + 0.5 * ({x})))"
    poly = "0.0"
    for c in reversed(ERFC):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def sql_p(z: str) -> str:
    """The two-sided p of a normal z."""
    return sql_erfc(f"(abs({z}) / sqrt(2.0))")


def sql_chi2(x: str, df: str) -> str:
    """The upper tail of chi-square for whole degrees of freedom, by its finite sums."""
    even = f"exp(-({x}) / 2) * list_sum([pow(({x}) / 2, i) / gamma(i + 1.0) for i in range(0, ({df} // 2)::BIGINT)])"
    odd = f"{sql_erfc(f'sqrt(({x}) / 2)')} + exp(-({x}) / 2) * coalesce(list_sum([pow(({x}) / 2, i + 0.5) / gamma(i + 1.5) for i in range(0, (({df} - 1) // 2)::BIGINT)]), 0)"
    return f"(CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def sql_label(lo: str, hi: str, expect: str) -> str:
    return f"CASE WHEN {expect} IS NULL THEN 'not_tested' WHEN {lo} IS NULL THEN 'unavailable' WHEN {lo} <= 0 AND {hi} >= 0 THEN 'no_clear_difference' WHEN {expect} = '!=' OR ({lo} > 0) = ({expect} = '>') THEN 'consistent' ELSE 'inconsistent' END"


def sql_holm_label(direction: str, p: str, expect: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 'unavailable' WHEN {expect} IS NULL THEN 'not_tested' WHEN {p} >= 0.05 THEN 'no_clear_difference' WHEN {expect} = '!=' THEN 'consistent' WHEN coalesce({direction}, 0) = 0 THEN 'no_clear_difference' WHEN ({direction} > 0) = ({expect} = '>') THEN 'consistent' ELSE 'inconsistent' END"


_TERM = "-(lgamma(x + 1.0) + lgamma(na - x + 1.0) + lgamma(ka + kb - x + 1.0) + lgamma(nb - ka - kb + x + 1.0))"
FISHER = f"list_sum([CASE WHEN {_TERM} <= own + 1e-7 THEN exp({_TERM} + whole) ELSE 0 END for x in range(greatest(0, ka + kb - nb), least(na, ka + kb) + 1)])"
#: All pairs of nations with over ten customers: some tables have expected cells under five.
_NATIONS = f"""WITH c AS ({_DEBT}), p AS (SELECT a.nation AS a, a.n AS na, a.k AS ka, b.nation AS b, b.n AS nb, b.k AS kb, a.k / a.n::DOUBLE AS pa, b.k / b.n::DOUBLE AS pb FROM c a JOIN c b ON a.nation < b.nation WHERE a.n >= 10 AND b.n >= 10),
l AS (SELECT *, pa - pb - sqrt(pow(pa - {WLO('ka', 'na')}, 2) + pow({WHI('kb', 'nb')} - pb, 2)) AS lo, pa - pb + sqrt(pow({WHI('ka', 'na')} - pa, 2) + pow(pb - {WLO('kb', 'nb')}, 2)) AS hi, least(na, nb) * least(ka + kb, na + nb - ka - kb) / (na + nb)::DOUBLE AS least_cell, (pa - pb) / sqrt((ka + kb) / (na + nb)::DOUBLE * (1 - (ka + kb) / (na + nb)::DOUBLE) * (1.0 / na + 1.0 / nb)) AS z,
 -(lgamma(ka + 1.0) + lgamma(na - ka + 1.0) + lgamma(kb + 1.0) + lgamma(nb - kb + 1.0)) AS own, lgamma(na + 1.0) + lgamma(nb + 1.0) + lgamma(ka + kb + 1.0) + lgamma(na + nb - ka - kb + 1.0) - lgamma(na + nb + 1.0) AS whole FROM p),
t AS (SELECT *, CASE WHEN least_cell < 5 THEN least(1.0, {FISHER}) ELSE {sql_p('z')} END AS p, CASE WHEN least_cell < 5 THEN 'fisher_exact' ELSE 'pooled_z' END AS test, pa - pb AS value FROM l) """
_HOLM = "least(1.0, max(step) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING))"
_STEPS = "(SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p AS step FROM t)"


def nation_pairs(spark, sf_dir, expect=">"):
    """The contrasts of owing customers between all pairs of nations."""
    return contrasts.compare(debts(spark, sf_dir).withColumnRenamed("nation", "grp"), expect).where("p is not null")


@query("t02_compare_groups", _CNT + f" SELECT a, na, ka, b, nb, kb, round(pa - pb, 8) AS value, round(lo, 8) AS lo, round(hi, 8) AS hi, round(z, 8) AS z, round(2 * asin(sqrt(pa)) - 2 * asin(sqrt(pb)), 8) AS h, round({sql_p('z')}, 5) AS p, 'pooled_z' AS test, {sql_label('lo', 'hi', chr(39) + '>' + chr(39))} AS label FROM i")
def compare_groups(spark, sf_dir):
    """Every pair of segments by the share of low balances; a is expected to be higher."""
    f = ORDERS.where("balance", ["low"])
    found = contrasts.compare(estimates.counts(respondents(spark, sf_dir), f.universe, f.mask, ORDERS.groups("segment")), ">")
    return rounded(found.withColumn("p", F.round("p", 5)))


@query("t05_p_values", _NATIONS + f"SELECT a, b, test, round(p, 5) AS p, round({_HOLM}, 4) AS p_holm FROM {_STEPS}")
def p_values(spark, sf_dir):
    """p of every pair by pooled z, or Fisher's exact test if an expected cell is under five; Holm over the pack."""
    pairs = nation_pairs(spark, sf_dir).withColumn("pack", F.lit("nations"))
    return pairs.select("a", "b", "test", F.round("p", 5).alias("p"), F.round(stats.holm(F.col("p"), ["pack"], ["a", "b"]), 4).alias("p_holm"))


_BIN = lambda a, b: f"list_sum([exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.1) + (n - i) * ln(0.9)) for i in range({a}, {b})])"
_OVER = f"""WITH d AS ({_DEBT}), e AS (SELECT *, least(n * 0.1, n * 0.9) < 5 AS exact FROM d WHERE n >= 10),
t AS (SELECT nation, n, k, exact, CASE WHEN exact THEN least(1.0, 2 * least({_BIN('0', 'k + 1')}, {_BIN('k', 'n + 1')})) ELSE {sql_p('(k / n::DOUBLE - 0.1) / sqrt(0.09 / n)')} END AS p FROM e) """


@query("t06_threshold", _OVER + f"""SELECT nation AS grp, n, k, round(k / n::DOUBLE - 0.1, 8) AS value, CASE WHEN NOT exact THEN round({WLO('k', 'n')} - 0.1, 8) END AS lo, CASE WHEN NOT exact THEN round({WHI('k', 'n')} - 0.1, 8) END AS hi, round(p, 5) AS p, CASE WHEN exact THEN 'exact_binomial' ELSE 'score_z' END AS test,
CASE WHEN p >= 0.05 THEN 'no_clear_difference' WHEN k / n::DOUBLE > 0.1 THEN 'consistent' ELSE 'inconsistent' END AS label FROM t""")
def threshold(spark, sf_dir):
    """Each nation's share of owing customers against a tenth; the exact interval and test where either side expects under five.

    SQL has the exact p but no Clopper-Pearson interval, so that isn't shown; the label comes from it and SQL takes it from p.
    """
    found = contrasts.against(debts(spark, sf_dir).withColumnRenamed("nation", "grp"), 0.1, ">").where("n >= 10")
    score = lambda c: F.when(F.col("test") == "score_z", F.col(c))
    return rounded(found.withColumns({"lo": score("lo"), "hi": score("hi"), "p": F.round("p", 5)}))


@query("t08_holm", _OVER + "SELECT nation, round(p, 5) AS p, round(least(1.0, max(step) OVER (ORDER BY p, nation ROWS UNBOUNDED PRECEDING)), 4) AS p_holm FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, nation) + 1) * p AS step FROM t)")
def holm(spark, sf_dir):
    """Step-down adjustment of the p of each nation's share against a tenth."""
    tested = contrasts.against(debts(spark, sf_dir).withColumnRenamed("nation", "grp"), 0.1).where("p is not null").withColumn("pack", F.lit("one"))
    return tested.select(F.col("grp").alias("nation"), F.round("p", 5).alias("p"), F.round(stats.holm(F.col("p"), ["pack"], ["grp"]), 4).alias("p_holm"))


_EXPECT = "CASE nation % 4 WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '!=' END"


@query("t16_declared_labels", f"SELECT nation, expected, {sql_label('lo', 'hi', 'expected')} AS label FROM (SELECT nation, {_EXPECT} AS expected, {WLO('k', 'n')} - 0.1 AS lo, {WHI('k', 'n')} - 0.1 AS hi FROM ({_DEBT}))")
def declared_labels(spark, sf_dir):
    """The label of an interval against a declared direction, a declared difference, or none declared."""
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    at = F.col("nation") % 4
    expected = F.when(at == 0, ">").when(at == 1, "<").when(at == 2, "!=")
    return debts(spark, sf_dir).select("nation", expected.alias("expected"), stats.contrast_label(lo - 0.1, hi - 0.1, expected).alias("label"))


#: A pack of three parts: pairs of segments, of regions, and a pooled odds ratio.
_PACK_SQL = SQL + f""", c AS (SELECT 's1' AS part, segment AS grp, count(*) AS n, count(*) FILTER (balance = 'low') AS k FROM r WHERE segment IS NOT NULL AND {_BB} GROUP BY 1, 2 UNION ALL SELECT 's2', region, count(*), count(*) FILTER (status = 'O') FROM r WHERE region IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2),
i AS (SELECT a.part, a.grp AS a, b.grp AS b, a.k / a.n::DOUBLE - b.k / b.n::DOUBLE AS value, (a.k / a.n::DOUBLE - b.k / b.n::DOUBLE) / sqrt((a.k + b.k) / (a.n + b.n)::DOUBLE * (1 - (a.k + b.k) / (a.n + b.n)::DOUBLE) * (1.0 / a.n + 1.0 / b.n)) AS z FROM c a JOIN c b ON a.part = b.part AND a.grp < b.grp),
t AS (SELECT *, {sql_p('z')} AS p, CASE WHEN part = 's1' THEN '>' WHEN a = 'ASIA' THEN '!=' END AS expect FROM i) """
_ADJUSTED = "SELECT *, least(1.0, max(step) OVER (ORDER BY p, part, a, b ROWS UNBOUNDED PRECEDING)) AS p_holm FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, part, a, b) + 1) * p AS step FROM t)"


def evidence(spark, sf_dir):
    """The contrasts of a pack: low balances between segments, and open orders between regions."""
    df = respondents(spark, sf_dir)
    low, open_ = ORDERS.where("balance", ["low"]), ORDERS.where("status", ["O"])
    s1 = contrasts.compare(estimates.counts(df, low.universe, low.mask, ORDERS.groups("segment"))).withColumns({"part": F.lit("s1"), "expect": F.lit(">")})
    s2 = contrasts.compare(estimates.counts(df, open_.universe, open_.mask, ORDERS.groups("region"))).withColumns({"part": F.lit("s2"), "expect": F.when(F.col("a") == "ASIA", "!=")})
    both = s1.unionByName(s2).withColumns({"pack": F.lit("orders"), "value_scale": F.lit("difference")})
    return contrasts.pack(both, ["pack"], ["part", "a", "b"])


@query("l01_evidence_pack", _PACK_SQL + f"SELECT concat(part, '.r', row_number() OVER (PARTITION BY part ORDER BY a, b)) AS id, a, b, round(p, 5) AS p, round(p_holm, 4) AS p_holm, sign(value)::INT AS direction, count(*) OVER () AS test_count FROM ({_ADJUSTED})")
def evidence_pack(spark, sf_dir):
    """Ids by subclaim, p, and its Holm adjustment over all tests of the pack, across subclaims."""
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("pack", "part").orderBy("a", "b"))
    return evidence(spark, sf_dir).select(F.concat("part", F.lit(".r"), seq).alias("id"), "a", "b", F.round("p", 5).alias("p"), F.round("p_holm", 4).alias("p_holm"), "direction", "test_count")


@query("t17_adjusted_labels", _PACK_SQL + f"SELECT part, a, b, expect, {sql_holm_label('sign(value)', 'p_holm', 'expect')} AS label FROM ({_ADJUSTED})")
def adjusted_labels(spark, sf_dir):
    """Labels by the sign of the effect and the adjusted p."""
    return evidence(spark, sf_dir).select("part", "a", "b", "expect", F.col("label_holm").alias("label"))


@query("k02_label_after_holm", _PACK_SQL + f"SELECT part, a, b, CASE WHEN a = 'BUILDING' THEN 'recorded' ELSE {sql_holm_label('sign(value)', 'p_holm', 'expect')} END AS label_holm FROM ({_ADJUSTED})")
def label_after_holm(spark, sf_dir):
    """The recorded label after Holm where there is one, else the one worked out again."""
    recorded = F.when(F.col("a") == "BUILDING", "recorded")
    return evidence(spark, sf_dir).select("part", "a", "b", F.coalesce(recorded, "label_holm").alias("label_holm"))


@query("t18_comparisons", _NATIONS + f"SELECT a::VARCHAR AS a, b::VARCHAR AS b, round(value, 8) AS value, round(p, 5) AS p, {sql_label('lo', 'hi', chr(39) + '!=' + chr(39))} AS label, '' AS error FROM t UNION ALL SELECT 'all', '0', NULL, NULL, NULL, 'WrongThreshold' UNION ALL SELECT 'all', 'pairs', NULL, NULL, NULL, 'WrongExpectation'")
def comparisons(spark, sf_dir):
    """Pairs of which only a difference is expected; a threshold outside (0, 1) and an unknown expectation give error rows."""
    counted = debts(spark, sf_dir).withColumnRenamed("nation", "grp")
    found = nation_pairs(spark, sf_dir, "!=").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.round("value", 8).alias("value"), F.round("p", 5).alias("p"), "label", F.lit("").alias("error"))
    for b, call in (("0", lambda: contrasts.against(counted, 0.0)), ("pairs", lambda: contrasts.compare(counted, "higher"))):
        try:
            call()
        except ValueError as e:
            row = counted.limit(1).select(F.lit("all").alias("a"), F.lit(b).alias("b"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("string").alias("label"), F.lit(str(e).split(":")[0]).alias("error"))
            found = found.unionByName(row)
    return found


@query("t12_trend", SQL + f""", d AS (SELECT CASE balance WHEN 'low' THEN 0 WHEN 'middle' THEN 1 WHEN 'high' THEN 2 END AS x, {_SCORE} AS y FROM r), q AS (SELECT x, y::DOUBLE AS y FROM d WHERE x IS NOT NULL AND y IS NOT NULL),
m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM q), e AS (SELECT pow(x - mx, 2) * pow((y - my - b * (x - mx)) / (1 - (1.0 / n + pow(x - mx, 2) / sxx)), 2) AS t, n, b, sxx FROM q, m), f AS (SELECT max(n) AS n, max(b) AS slope, sqrt(sum(t)) / max(sxx) AS se FROM e)
SELECT n, round(slope, 8) AS slope, round(se, 8) AS se, round(slope - {Z} * se, 8) AS lo, round(slope + {Z} * se, 8) AS hi, round({sql_p('slope / se')}, 5) AS p, {sql_label(f'(slope - {Z} * se)', f'(slope + {Z} * se)', chr(39) + '>' + chr(39))} AS label FROM f""")
def trend(spark, sf_dir):
    """Slope of priority over balance with interval, p and label; it is expected to increase."""
    y = estimates.score(ORDERS, "priority").cast("double")
    x = F.when(F.col("balance") == "low", 0).when(F.col("balance") == "middle", 1).when(F.col("balance") == "high", 2)
    sums = respondents(spark, sf_dir).where(ORDERS.ordered_base("priority") & ORDERS.base("balance")).groupBy(x.alias("position")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    return rounded(contrasts.trend(sums).withColumns({"p": F.round("p", 5), "label": stats.contrast_label(F.col("lo"), F.col("hi"), F.lit(">"))}))


@query("t04_association", SQL + f", c AS (SELECT segment AS x, priority AS y, count(*) AS k FROM r WHERE segment IS NOT NULL AND priority IS NOT NULL GROUP BY 1, 2), e AS (SELECT *, sum(k) OVER (PARTITION BY x) * sum(k) OVER (PARTITION BY y) / (sum(k) OVER ())::DOUBLE AS e FROM c), s AS (SELECT sum(k)::BIGINT AS n, sum(pow(k - e, 2) / e) AS chi2, count(DISTINCT x) AS a, count(DISTINCT y) AS b FROM e), u AS (SELECT *, ((a - 1) * (b - 1))::BIGINT AS df FROM s) SELECT n, round(chi2, 6) AS chi2, df, round(sqrt(chi2 / (n * (least(a, b) - 1))), 6) AS v, round({sql_chi2('chi2', 'df')}, 5) AS p FROM u")
def association(spark, sf_dir):
    cells = respondents(spark, sf_dir).where(ORDERS.base("segment") & ORDERS.base("priority")).groupBy(F.col("segment").alias("x"), F.col("priority").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    return rounded(contrasts.association(cells).withColumn("p", F.round("p", 5)), 6)


_PAIRS = [("segment", "region"), ("segment", "status"), ("region", "status")]


@query("t14_association_tests", SQL + ", c AS (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {x} AS u, {y} AS v, count(*) AS k FROM r WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 3, 4" for x, y in _PAIRS) + f"), e AS (SELECT *, sum(k) OVER (PARTITION BY x, y, u) * sum(k) OVER (PARTITION BY x, y, v) / (sum(k) OVER (PARTITION BY x, y))::DOUBLE AS e FROM c), s AS (SELECT x, y, sum(k)::BIGINT AS n, sum(pow(k - e, 2) / e) AS chi2, count(DISTINCT u) AS a, count(DISTINCT v) AS b FROM e GROUP BY 1, 2), w AS (SELECT *, ((a - 1) * (b - 1))::BIGINT AS df FROM s) SELECT x, y, n, round(chi2, 6) AS chi2, df, round(sqrt(chi2 / (n * (least(a, b) - 1))), 6) AS v, round({sql_chi2('chi2', 'df')}, 5) AS p FROM w")
def association_tests(spark, sf_dir):
    """Chi-square, Cramer's V and p of every pair of single-choice variables, from one scan."""
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.when(ORDERS.base(x) & ORDERS.base(y), F.struct(F.col(x).alias("u"), F.col(y).alias("v"))).alias("c")) for x, y in _PAIRS])
    cells = respondents(spark, sf_dir).select(F.inline(pairs)).where("c is not null").groupBy("x", "y", "c.u", "c.v").agg(F.count(F.lit(1)).alias("k"))
    return rounded(contrasts.associations(cells).withColumn("p", F.round("p", 5)), 6)


@query("t20_joint_cells", SQL + f", c AS (SELECT segment AS x, status AS y, count(*) AS n FROM r WHERE segment IS NOT NULL AND status IS NOT NULL AND balance = 'low' AND region = 'ASIA' GROUP BY 1, 2) SELECT x, y, CASE WHEN n >= 10 THEN n END AS n, sum(n) OVER ()::BIGINT AS base, sum(n) OVER () >= 10 AS tested FROM c")
def joint_cells(spark, sf_dir):
    """The table behind an association, in the joint observed base of a subgroup: cells under ten are not shown, nor a base under ten tested."""
    among = ORDERS.where("balance", ["low"]) & ORDERS.where("region", ["ASIA"])
    cells = respondents(spark, sf_dir).where(ORDERS.base("segment") & ORDERS.base("status") & among.mask).groupBy(F.col("segment").alias("x"), F.col("status").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return contrasts.shown_cells(cells)


_STRATA = SQL + f""", s AS (SELECT region, status, count(*) FILTER (segment = 'BUILDING' AND balance = 'low') AS a, count(*) FILTER (segment = 'BUILDING' AND balance <> 'low') AS b, count(*) FILTER (segment = 'MACHINERY' AND balance = 'low') AS c, count(*) FILTER (segment = 'MACHINERY' AND balance <> 'low') AS d FROM r WHERE {_BB} AND segment IN ('BUILDING','MACHINERY') AND region IS NOT NULL GROUP BY 1, 2) """


def strata(spark, sf_dir):
    df = respondents(spark, sf_dir).where(ORDERS.base("balance") & F.col("segment").isin("BUILDING", "MACHINERY") & ORDERS.base("region"))
    low, a = F.col("balance") == "low", F.col("segment") == "BUILDING"
    return df.groupBy(F.struct("region", "status").alias("stratum")).agg(F.count_if(a & low).alias("a"), F.count_if(a & ~low).alias("b"), F.count_if(~a & low).alias("c"), F.count_if(~a & ~low).alias("d"))


_SE = "sqrt(pr/(2*r*r) + ps/(2*r*s) + qs/(2*s*s))"


@query("t15_adjusted_comparison", _STRATA + f""", u AS (SELECT *, (a+b+c+d)::DOUBLE AS n, a+b+c+d >= 10 AND a+b > 0 AND c+d > 0 AS ok FROM s), x AS (SELECT sum(a*d/n) AS r, sum(b*c/n) AS s, sum((a+d)/n*a*d/n) AS pr, sum((a+d)/n*b*c/n + (b+c)/n*a*d/n) AS ps, sum((b+c)/n*b*c/n) AS qs, sum(a - (a+b)*(a+c)/n) AS gap, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) AS spread, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d, count(*) AS strata, bool_or(least(a+b, c+d) * least(a+c, b+d) / n < 5) AS sparse FROM u WHERE ok)
SELECT strata, (SELECT count(*) FROM u WHERE NOT ok) AS dropped, sparse, round(r / s, 8) AS odds_ratio, round(exp(ln(r/s) - {Z} * {_SE}), 8) AS lo, round(exp(ln(r/s) + {Z} * {_SE}), 8) AS hi, round({sql_p('(gap / sqrt(spread))')}, 5) AS p, {sql_label(f'(ln(r/s) - {Z} * {_SE})', f'(ln(r/s) + {Z} * {_SE})', chr(39) + '!=' + chr(39))} AS label, round(a*d/(b*c)::DOUBLE, 8) AS crude FROM x""")
def adjusted(spark, sf_dir):
    """Two segments compared within strata of region and status: pooled odds ratio, interval, p and label."""
    return rounded(contrasts.mantel_haenszel(strata(spark, sf_dir), "!=").withColumn("p", F.round("p", 5)))


@query("t15_breslow_day", _STRATA + f""", u AS (SELECT *, (a+b+c+d)::DOUBLE AS n FROM s WHERE a+b+c+d >= 10 AND a+b > 0 AND c+d > 0 AND a+c > 0 AND b+d > 0), o AS (SELECT sum(a*d/n) / sum(b*c/n) AS r FROM u),
e AS (SELECT *, (-(d - a + r*((a+b)+(a+c))) + sqrt(pow(d - a + r*((a+b)+(a+c)), 2) + 4*(1-r)*r*(a+b)*(a+c))) / (2*(1-r)) AS e FROM u, o), f AS (SELECT count(*) AS strata, sum(pow(a - e, 2) * (1/e + 1/(a+b-e) + 1/(a+c-e) + 1/(d-a+e))) AS statistic FROM e), g AS (SELECT *, strata - 1 AS df FROM f) SELECT strata, round(statistic, 6) AS statistic, df, round({sql_chi2('statistic', 'df')}, 5) AS p FROM g""")
def breslow_day(spark, sf_dir):
    """Whether the strata's odds ratios are equal."""
    return rounded(contrasts.breslow_day(strata(spark, sf_dir)).withColumn("p", F.round("p", 5)), 6)


@query("t23_adjusted_base", SQL + f""", m AS (SELECT *, region IS NOT NULL AND status IS NOT NULL AS covered, concat_ws('|', region, status) AS stratum FROM r WHERE {_BB} AND segment IN ('BUILDING','MACHINERY')), s AS (SELECT stratum, count(*) FILTER (segment = 'BUILDING') AS na, count(*) FILTER (segment = 'MACHINERY') AS nb FROM m WHERE covered GROUP BY 1)
SELECT CASE WHEN na + nb >= 10 AND na > 0 AND nb > 0 THEN 'kept' ELSE 'dropped' END AS part, count(*) AS strata, sum(na)::BIGINT AS na, sum(nb)::BIGINT AS nb FROM s GROUP BY 1 UNION ALL SELECT 'missing_controls', 0, count(*) FILTER (segment = 'BUILDING'), count(*) FILTER (segment = 'MACHINERY') FROM m WHERE NOT covered HAVING count(*) > 0""")
def adjusted_base(spark, sf_dir):
    """Who stands behind an adjusted comparison: strata that are kept and dropped, and respondents whose controls are missing."""
    df = respondents(spark, sf_dir).where(ORDERS.base("balance") & F.col("segment").isin("BUILDING", "MACHINERY"))
    return contrasts.stratum_bases(df, F.col("segment") == "BUILDING", ORDERS.base("region") & ORDERS.base("status"), ["region", "status"])


@query("t03_count_errors", f"SELECT nation, CASE WHEN nation % 5 = 0 THEN 'InvalidCounts' ELSE '' END AS error FROM ({_DEBT})")
def count_errors(spark, sf_dir):
    """Counts that can't be those of a sample (here: every fifth nation has more owing customers than customers) are named, not used."""
    broken = debts(spark, sf_dir).withColumn("k", F.when(F.col("nation") % 5 == 0, F.col("n") + 1).otherwise(F.col("k")))
    return broken.select("nation", F.when(stats.invalid_counts(F.col("k"), F.col("n")), "InvalidCounts").otherwise("").alias("error"))


# analyses given as rows
SPECS = [
    {"spec_id": "n1", "op": "subclaim", "text": "Low balances differ."},
    {"spec_id": "q1", "op": "share", "variable": "balance", "value": "low", "by": "segment"},
    {"spec_id": "q2", "op": "mean", "variable": "priority", "by": "region"},
    {"spec_id": "q3", "op": "top_box", "variable": "priority", "value": 2, "by": "segment", "among": {"eq": {"variable": "status", "value": "O"}}},
    {"spec_id": "q4", "op": "sizes", "variable": "status", "by": "region"},
    {"spec_id": "q5", "op": "distribution", "variable": "status"},
    {"spec_id": "q6", "op": "rank", "variable": "returns", "by": "status"},
    {"spec_id": "t1", "op": "compare", "of": "q1", "expect": "!="},
    {"spec_id": "t2", "op": "threshold", "of": "q3", "value": 0.5, "expect": ">"},
    {"spec_id": "t3", "op": "trend", "of": "q1", "order": ["AUTOMOBILE", "BUILDING", "FURNITURE"], "expect": "any"},
    {"spec_id": "p1", "op": "association", "variable": "segment", "by": "status"},
    {"spec_id": "p2", "op": "adjusted", "variable": "balance", "value": "low", "by": "segment", "a": "BUILDING", "b": "MACHINERY", "controls": ["region", "status"], "expect": ">"},
    {"spec_id": "d1", "op": "describe", "variable": "balance"},
    {"spec_id": "v1", "op": "values", "variable": "priority"},
    {"spec_id": "f1", "op": "find_variables", "text": "Segment", "k": 1},
    {"spec_id": "x7", "op": "values", "variable": "colour"},
    {"spec_id": "x8", "op": "find_variables", "text": "Segment", "k": 0},
    {"spec_id": "x9", "op": "compare", "of": "q1", "expect": "higher"},
    {"spec_id": "x1", "op": "share", "variable": "colour", "value": "red", "by": "segment"},
    {"spec_id": "x2", "op": "share", "variable": "balance", "value": "huge"},
    {"spec_id": "x3", "op": "median", "variable": "balance"},
    {"spec_id": "x4", "op": "compare", "of": "x1"},
    {"spec_id": "x5", "op": "mean", "variable": "segment"},
    {"spec_id": "x6", "op": "threshold", "of": "q3", "value": 2.0},
    {"spec_id": "n2", "op": "caveat", "text": "x" * 201},
]
_ROW = lambda **x: ", ".join(f"{x.get(name, 'NULL')}::{kind} AS {name}" for name, kind in [("spec_id", "VARCHAR"), ("op", "VARCHAR"), ("variable", "VARCHAR"), ("grp", "VARCHAR"), ("other", "VARCHAR"), ("n", "BIGINT"), ("value", "DOUBLE"), ("p", "DOUBLE"), ("label", "VARCHAR"), ("error", "VARCHAR")])
_NOTE = lambda i, op, v="NULL", label="NULL", error="": f"SELECT {_ROW(spec_id=repr(i), op=repr(op), variable=v, label=label, error=repr(error))}"
_Q1 = f"SELECT segment AS g, count(*) FILTER ({_BB}) AS n, count(*) FILTER (balance = 'low') AS k FROM r WHERE segment IS NOT NULL GROUP BY 1"
_Q3 = "SELECT segment AS g, count(*) FILTER (priority <> '4-NOT SPECIFIED') AS n, count(*) FILTER (priority IN ('1-URGENT', '2-HIGH')) AS k FROM r WHERE segment IS NOT NULL AND status = 'O' GROUP BY 1"
_DONE = "''"
SPEC_SQL = SQL + ", " + _STRATA.removeprefix(SQL).strip().removeprefix(",").strip() + f""", c AS ({_Q1}), q3 AS ({_Q3}),
i AS (SELECT a.g AS a, b.g AS b, a.n + b.n AS n, pa - pb AS value, pa - pb - sqrt(pow(pa - {WLO('ka', 'na')}, 2) + pow({WHI('kb', 'nb')} - pb, 2)) AS lo, pa - pb + sqrt(pow({WHI('ka', 'na')} - pa, 2) + pow(pb - {WLO('kb', 'nb')}, 2)) AS hi, (pa - pb) / sqrt((ka + kb) / (na + nb)::DOUBLE * (1 - (ka + kb) / (na + nb)::DOUBLE) * (1.0 / na + 1.0 / nb)) AS z
 FROM (SELECT *, n AS na, k AS ka, k / n::DOUBLE AS pa FROM c) a JOIN (SELECT *, n AS nb, k AS kb, k / n::DOUBLE AS pb FROM c) b ON a.g < b.g),
td AS (SELECT CASE g WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS x, n, k FROM c WHERE g IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')), tm AS (SELECT sum(n)::DOUBLE AS n, sum(n * x) / sum(n)::DOUBLE AS mx, sum(k) / sum(n)::DOUBLE AS my FROM td),
ts AS (SELECT sum(td.n * pow(x - mx, 2)) AS sxx, sum((x - mx) * k) AS sxy FROM td, tm), tf AS (SELECT max(tm.n)::BIGINT AS n, max(sxy / sxx) AS b, sqrt(sum(pow(x - mx, 2) * (k * pow(1 - my - sxy / sxx * (x - mx), 2) + (td.n - k) * pow(my + sxy / sxx * (x - mx), 2)) / pow(1 - (1 / tm.n + pow(x - mx, 2) / sxx), 2))) / max(sxx) AS se FROM td, tm, ts),
ac AS (SELECT segment AS u, status AS v, count(*) AS k FROM r WHERE segment IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2), ae AS (SELECT *, sum(k) OVER (PARTITION BY u) * sum(k) OVER (PARTITION BY v) / (sum(k) OVER ())::DOUBLE AS e FROM ac), aa AS (SELECT sum(k)::BIGINT AS n, sum(pow(k - e, 2) / e) AS chi2, ((count(DISTINCT u) - 1) * (count(DISTINCT v) - 1))::BIGINT AS df, least(count(DISTINCT u), count(DISTINCT v)) - 1 AS m FROM ae),
mu AS (SELECT *, (a+b+c+d)::DOUBLE AS n FROM s WHERE a+b+c+d >= 10 AND a+b > 0 AND c+d > 0), mx AS (SELECT sum(a*d/n) AS r, sum(b*c/n) AS s, sum((a+d)/n*a*d/n) AS pr, sum((a+d)/n*b*c/n + (b+c)/n*a*d/n) AS ps, sum((b+c)/n*b*c/n) AS qs, sum(a - (a+b)*(a+c)/n) AS gap, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) AS spread, count(*) AS strata FROM mu)
{_NOTE('n1', 'subclaim', label="'Low balances differ.'")} UNION ALL {_NOTE('n2', 'caveat', error='CaveatTooLong')} UNION ALL {_NOTE('x1', 'share', "'colour'", error='UnknownVariable')} UNION ALL {_NOTE('x2', 'share', "'balance'", error='UnknownValue')} UNION ALL {_NOTE('x3', 'median', "'balance'", error='UnknownOperation')} UNION ALL {_NOTE('x4', 'compare', error='UnknownEstimate')} UNION ALL {_NOTE('x5', 'mean', "'segment'", error='WrongAnswerType')} UNION ALL {_NOTE('x6', 'threshold', error='WrongThreshold')} UNION ALL {_NOTE('x7', 'values', "'colour'", error='UnknownVariable')} UNION ALL {_NOTE('x8', 'find_variables', error='WrongSearch')} UNION ALL {_NOTE('x9', 'compare', error='WrongExpectation')}
UNION ALL SELECT {_ROW(spec_id="'d1'", op="'describe'", variable="'balance'", grp="'All observed respondents'", other="'recorded'", n='count(balance)', error=_DONE)} FROM r UNION ALL SELECT {_ROW(spec_id="'d1'", op="'describe'", variable="'balance'", grp="'All observed respondents'", other="'observed'", n=f'count(*) FILTER ({_BB})', error=_DONE)} FROM r
UNION ALL SELECT {_ROW(spec_id="'v1'", op="'values'", variable="'priority'", other='x', n='i', error=_DONE)} FROM (VALUES (1, '5-LOW'), (2, '3-MEDIUM'), (3, '2-HIGH'), (4, '1-URGENT'), (5, '4-NOT SPECIFIED')) t(i, x)
UNION ALL SELECT {_ROW(spec_id="'f1'", op="'find_variables'", other="'segment'", n='1', value='1.0', error=_DONE)}
UNION ALL SELECT {_ROW(spec_id="'q1'", op="'share'", variable="'balance'", grp='g', n='n', value='round(k / n::DOUBLE, 8)', error=_DONE)} FROM c
UNION ALL SELECT {_ROW(spec_id="'q2'", op="'mean'", variable="'priority'", grp='region', n=f'count({_SCORE})', value=f'round(avg({_SCORE}), 8)', error=_DONE)} FROM r WHERE region IS NOT NULL GROUP BY region
UNION ALL SELECT {_ROW(spec_id="'q3'", op="'top_box'", variable="'priority'", grp='g', n='n', value='round(k / n::DOUBLE, 8)', error=_DONE)} FROM q3
UNION ALL SELECT {_ROW(spec_id="'q4'", op="'sizes'", variable="'status'", grp='region', n='count(status)', error=_DONE)} FROM r WHERE region IS NOT NULL GROUP BY region
UNION ALL SELECT {_ROW(spec_id="'q5'", op="'distribution'", variable="'status'", grp="'All observed respondents'", other='x', n='(SELECT count(status) FROM r)', value='round(count(*) / (SELECT count(status) FROM r)::DOUBLE, 8)', error=_DONE)} FROM (SELECT status AS x FROM r WHERE status IS NOT NULL) GROUP BY x
UNION ALL SELECT {_ROW(spec_id="'q6'", op="'rank'", variable="'returns'", grp='status', other='o', n='count(*)', value='round(count(*) FILTER (v) / count(*)::DOUBLE, 8)', error=_DONE)} FROM (SELECT status, unnest(['ret_a', 'ret_n', 'ret_r']) AS o, unnest([ret_a, ret_n, ret_r]) AS v FROM r WHERE status IS NOT NULL AND (ret_a IS NOT NULL OR ret_n IS NOT NULL OR ret_r IS NOT NULL)) GROUP BY status, o
UNION ALL SELECT {_ROW(spec_id="'t1'", op="'compare'", grp='a', other='b', n='n', value='round(value, 8)', p=f"round({sql_p('z')}, 5)", label=sql_label('lo', 'hi', "'!='").join('()'), error=_DONE)} FROM i
UNION ALL SELECT {_ROW(spec_id="'t2'", op="'threshold'", grp='g', n='n', value='round(k / n::DOUBLE - 0.5, 8)', p=f"round({sql_p('((k / n::DOUBLE - 0.5) / sqrt(0.25 / n))')}, 5)", label=sql_label(f"({WLO('k', 'n')} - 0.5)", f"({WHI('k', 'n')} - 0.5)", "'>'").join('()'), error=_DONE)} FROM q3
UNION ALL SELECT {_ROW(spec_id="'t3'", op="'trend'", n='n', value='round(b, 8)', p=f"round({sql_p('(b / se)')}, 5)", label=sql_label(f'(b - {Z} * se)', f'(b + {Z} * se)', "'!='").join('()'), error=_DONE)} FROM tf
UNION ALL SELECT {_ROW(spec_id="'p1'", op="'association'", variable="'segment'", other="'status'", n='n', value='round(sqrt(chi2 / (n * m)), 8)', p=f"round({sql_chi2('chi2', 'df')}, 5)", error=_DONE)} FROM aa
UNION ALL SELECT {_ROW(spec_id="'p2'", op="'adjusted'", variable="'balance'", grp="'BUILDING'", other="'MACHINERY'", n='strata', value='round(r / s, 8)', p=f"round({sql_p('(gap / sqrt(spread))')}, 5)", label=sql_label(f'(ln(r/s) - {Z} * {_SE})', f'(ln(r/s) + {Z} * {_SE})', "'>'").join('()'), error=_DONE)} FROM mx"""


@query("u01_spec_runner", SPEC_SQL)
def spec_runner(spark, sf_dir):
    """Analyses given as rows are run in bulk, all operations of a program; one that can't be run becomes a row with its error code."""
    return rounded(run_specs(respondents(spark, sf_dir), ORDERS, SPECS)).withColumn("p", F.round("p", 5))


@query("u02_reference_run", f"SELECT spec_id, count(*) AS rows, max(error) AS error FROM ({SPEC_SQL}) GROUP BY 1")
def reference_run(spark, sf_dir):
    """The same program a second time, summed up by spec: what a program gives doesn't depend on the run."""
    return run_specs(respondents(spark, sf_dir), ORDERS, SPECS[::-1]).groupBy("spec_id").agg(F.count(F.lit(1)).alias("rows"), F.max("error").alias("error"))
