"""Queries of filters, estimates, tests and the evidence log."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions import stats
from tallywright.operators import contrasts, estimates

from .registry import query
from .study import ORDERS, SQL, respondents

Z = stats.Z
WLO = lambda k, n: f"(({k})/({n})::DOUBLE + {Z*Z}/(2*({n})) - {Z}*sqrt((({k})/({n})::DOUBLE)*(1-({k})/({n})::DOUBLE)/({n}) + {Z*Z}/(4.0*({n})*({n}))))/(1+{Z*Z}/({n}))"
WHI = lambda k, n: f"(({k})/({n})::DOUBLE + {Z*Z}/(2*({n})) + {Z}*sqrt((({k})/({n})::DOUBLE)*(1-({k})/({n})::DOUBLE)/({n}) + {Z*Z}/(4.0*({n})*({n}))))/(1+{Z*Z}/({n}))"
FLAGS = "concat_ws(',', CASE WHEN n < 30 THEN 'small_n' END, CASE WHEN n > 0 AND n < 10 THEN 'suppressed' END, CASE WHEN n = 0 THEN 'empty_segment' END, CASE WHEN n >= 10 AND (k < 10 OR n - k < 10) THEN 'sparse_count' END)"
SHARES = f"n, CASE WHEN n >= 10 THEN round(k / n::DOUBLE, 8) END AS value, CASE WHEN n >= 10 THEN round({WLO('k','n')}, 8) END AS lo, CASE WHEN n >= 10 THEN round({WHI('k','n')}, 8) END AS hi, {FLAGS} AS flags, CASE WHEN n >= 10 THEN k END AS numerator"
SEGMENTS = "(VALUES ('AUTOMOBILE'),('BUILDING'),('FURNITURE'),('HOUSEHOLD'),('MACHINERY')) g(grp)"


def rounded(df, digits: int = 8):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query("f01_observed_bases", SQL + " SELECT variable, count(*) AS n_all, count(*) FILTER (base) AS n_base FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {b} AS base FROM r" for v, b in [*[(v, f"coalesce({v} <> 'Prefer not to say', false)") for v in ("status", "priority", "segment", "region", "balance")], *[(v, "(ret_a IS NOT NULL OR ret_n IS NOT NULL OR ret_r IS NOT NULL)") for v in ("ret_a", "ret_n", "ret_r")]]) + ") GROUP BY 1")
def observed_bases(spark, sf_dir):
    names = ["status", "priority", "segment", "region", "balance", "ret_a", "ret_n", "ret_r"]
    return respondents(spark, sf_dir).select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), ORDERS.eligible(v).mask.alias("base")) for v in names]))).groupBy("variable").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("base").alias("n_base"))


TREES = {
    "not": '{"not": {"eq": {"variable": "balance", "value": "low"}}}',
    "and": '{"and": [{"eq": {"variable": "balance", "value": "low"}}, {"eq": {"variable": "ret_r", "value": true}}]}',
    "or": '{"or": [{"eq": {"variable": "balance", "value": "high"}}, {"eq": {"variable": "ret_a", "value": true}}]}',
    "eligible": '{"and": [{"eligible": "ret_n"}, {"not": {"eq": {"variable": "status", "value": "F"}}}]}',
}
_RB, _BB = "(ret_a IS NOT NULL OR ret_n IS NOT NULL OR ret_r IS NOT NULL)", "coalesce(balance <> 'Prefer not to say', false)"


@query("f02_filter_trees", SQL + f""" SELECT 'not' AS filter, count(*) FILTER ({_BB}) AS universe, count(*) FILTER ({_BB} AND balance <> 'low') AS selected FROM r
UNION ALL SELECT 'and', count(*) FILTER ({_BB} AND {_RB}), count(*) FILTER ({_BB} AND {_RB} AND balance = 'low' AND ret_r) FROM r
UNION ALL SELECT 'or', count(*) FILTER ({_BB} AND {_RB}), count(*) FILTER ({_BB} AND {_RB} AND (balance = 'high' OR ret_a)) FROM r
UNION ALL SELECT 'eligible', count(*) FILTER (status IS NOT NULL), count(*) FILTER ({_RB} AND status <> 'F') FROM r""")
def filter_trees(spark, sf_dir):
    rows = [F.struct(F.lit(k).alias("filter"), (f := ORDERS.tree(t)).mask.alias("m"), f.universe.alias("u")) for k, t in TREES.items()]
    return respondents(spark, sf_dir).select(F.inline(F.array(*rows))).groupBy("filter").agg(F.count_if("u").alias("universe"), F.count_if("m").alias("selected"))


@query("f03_segment_sizes", SQL + " SELECT segment AS grp, count(*) AS size, count(*) FILTER (status = 'O') AS among_open FROM r WHERE segment IS NOT NULL GROUP BY 1")
def segment_sizes(spark, sf_dir):
    g, among = ORDERS.groups("segment"), ORDERS.where("status", ["O"])
    one = respondents(spark, sf_dir).agg(*[a for i, f in enumerate(g.values()) for a in (F.count_if(f.mask).alias(f"a{i}"), F.count_if((f & among).mask).alias(f"b{i}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("grp"), F.col(f"a{i}").alias("size"), F.col(f"b{i}").alias("among_open")) for i, k in enumerate(g)])))


@query("f04_group_overlaps", SQL + " SELECT count(*) FILTER (segment IN ('BUILDING','MACHINERY') AND region = 'ASIA') AS overlap_ab, count(*) FILTER (segment = 'BUILDING' AND segment = 'MACHINERY') AS overlap_none FROM r")
def overlaps(spark, sf_dir):
    a, b = ORDERS.where("segment", ["BUILDING", "MACHINERY"]), ORDERS.where("region", ["ASIA"])
    x, y = ORDERS.where("segment", ["BUILDING"]), ORDERS.where("segment", ["MACHINERY"])
    return respondents(spark, sf_dir).agg(F.count_if((a & b).mask).alias("overlap_ab"), F.count_if((x & y).mask).alias("overlap_none"))


@query("a01_share_by_group", SQL + f", c AS (SELECT grp, count(*) FILTER ({_BB} AND segment = grp) AS n, count(*) FILTER (balance = 'low' AND segment = grp) AS k FROM r, {SEGMENTS} GROUP BY 1) SELECT grp, {SHARES} FROM c")
def share_by_group(spark, sf_dir):
    return rounded(estimates.proportion(respondents(spark, sf_dir), ORDERS, "balance", "low", ORDERS.groups("segment")))


@query("a02_checkbox_share", SQL + f", c AS (SELECT 'All observed respondents' AS grp, count(*) FILTER ({_RB}) AS n, count(*) FILTER (ret_r) AS k FROM r) SELECT grp, {SHARES} FROM c")
def checkbox_share(spark, sf_dir):
    return rounded(estimates.proportion(respondents(spark, sf_dir), ORDERS, "ret_r", True))


@query("a03_distribution", SQL + f""", b AS (SELECT region AS grp, status AS answer, count(*) AS k FROM r WHERE region IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2), t AS (SELECT grp, sum(k)::BIGINT AS n FROM b GROUP BY 1),
c AS (SELECT t.grp, a.answer, n, coalesce(k, 0) AS k FROM t CROSS JOIN (VALUES ('F'),('O'),('P')) a(answer) LEFT JOIN b ON b.grp = t.grp AND b.answer = a.answer) SELECT grp, answer, {SHARES} FROM c""")
def distribution(spark, sf_dir):
    return rounded(estimates.distribution(respondents(spark, sf_dir), ORDERS, "status", "region"))


@query("a04_rank_options", SQL + f""", c AS (SELECT option, grp, count(*) FILTER ({_RB} AND segment = grp) AS n, count(*) FILTER (v AND segment = grp) AS k FROM (SELECT *, unnest(['ret_a','ret_n','ret_r']) AS option, unnest([ret_a, ret_n, ret_r]) AS v FROM r), {SEGMENTS} GROUP BY 1, 2)
SELECT option, grp, {SHARES}, CASE WHEN n >= 10 THEN rank() OVER (PARTITION BY grp, n < 10 ORDER BY k / n::DOUBLE DESC) END AS position FROM c""")
def rank_options(spark, sf_dir):
    return rounded(estimates.rank_options(respondents(spark, sf_dir), ORDERS, "returns", ORDERS.groups("segment")))


@query("a06_top_box", SQL + f", c AS (SELECT grp, count(*) FILTER (priority <> '4-NOT SPECIFIED' AND segment = grp) AS n, count(*) FILTER (priority IN ('1-URGENT','2-HIGH') AND segment = grp) AS k FROM r, {SEGMENTS} GROUP BY 1) SELECT grp, {SHARES} FROM c")
def top_box(spark, sf_dir):
    return rounded(estimates.top_box(respondents(spark, sf_dir), ORDERS, "priority", 2, ORDERS.groups("segment")))


_SCORE = "CASE priority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END"


@query("a07_mean_score", SQL + f" SELECT region AS grp, count(y) AS n, round(avg(y), 8) AS mean, round(stddev_samp(y), 8) AS sd FROM (SELECT region, {_SCORE} AS y FROM r) WHERE y IS NOT NULL AND region IS NOT NULL GROUP BY 1")
def mean_score(spark, sf_dir):
    return rounded(estimates.mean_scores(respondents(spark, sf_dir), ORDERS, "priority", "region"))


@query("a10_fingerprints", SQL + " SELECT segment AS grp, count(*) AS n, bit_xor(('0x' || substr(sha256(respondent_id::VARCHAR), 1, 15))::BIGINT) AS fingerprint FROM r WHERE segment IS NOT NULL GROUP BY 1")
def fingerprints(spark, sf_dir):
    return respondents(spark, sf_dir).where("segment is not null").groupBy(F.col("segment").alias("grp")).agg(F.count(F.lit(1)).alias("n"), estimates.fingerprint(F.col("respondent_id")).alias("fingerprint"))


@query("a12_inventory", SQL + ", p AS (" + " UNION ALL ".join(f"SELECT '{m}' AS variable, {m} AS answer, '{b}' AS grouping, {b} AS grp FROM r" for m in ("status", "priority", "balance") for b in ("segment", "region", "status") if m != b) + ") SELECT variable, answer, \"grouping\", grp, count(*) AS k, sum(count(*)) OVER (PARTITION BY variable, \"grouping\", grp)::BIGINT AS n FROM p WHERE answer IS NOT NULL AND grp IS NOT NULL AND answer <> 'Prefer not to say' AND grp <> 'Prefer not to say' GROUP BY 1, 2, 3, 4")
def inventory(spark, sf_dir):
    return estimates.inventory(respondents(spark, sf_dir), ["status", "priority", "balance"], ["segment", "region", "status"], "respondent_id")


@query("a14_against_population", """
WITH s AS (SELECT r_name AS region, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
p AS (SELECT r_name AS region, count(*) AS pn, count(*) FILTER (c_acctbal >= 0) AS pk FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT region, n, round(k / n::DOUBLE, 8) AS sample_share, round(pk / pn::DOUBLE, 8) AS population_share, CASE WHEN abs(k / n::DOUBLE - pk / pn::DOUBLE) < 0.02 THEN 'agrees' WHEN k / n::DOUBLE > pk / pn::DOUBLE THEN 'sample_higher' ELSE 'sample_lower' END AS relation FROM s JOIN p USING (region)""")
def against_population(spark, sf_dir):
    from .registry import table

    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    truth = people.groupBy(F.col("r_name").alias("region")).agg((F.count_if(F.col("c_acctbal") >= 0) / F.count(F.lit(1))).alias("population_share"))
    sample = respondents(spark, sf_dir).where("region is not null").groupBy("region").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("status") == "O") / F.count(F.lit(1))).alias("sample_share"))
    gap = F.col("sample_share") - F.col("population_share")
    return rounded(sample.join(truth, "region").select("region", "n", "sample_share", "population_share", F.when(F.abs(gap) < 0.02, "agrees").when(gap > 0, "sample_higher").otherwise("sample_lower").alias("relation")))


@query("a16_denominator_gap", SQL + " SELECT count(*) AS shown, count(*) FILTER (ret_a IS NULL AND ret_n IS NULL AND ret_r IS NULL) AS not_answered, count(*) FILTER (NOT coalesce(ret_r, false) AND (ret_a IS NOT NULL OR ret_n IS NOT NULL)) AS answered_not_selected FROM r")
def denominator_gap(spark, sf_dir):
    base = ORDERS.base("ret_r")
    return respondents(spark, sf_dir).agg(F.count(F.lit(1)).alias("shown"), F.count_if(~base).alias("not_answered"), F.count_if(base & ~F.coalesce("ret_r", F.lit(False))).alias("answered_not_selected"))


_CNT = SQL + ", c AS (SELECT segment AS grp, count(*) AS n, count(*) FILTER (balance = 'low') AS k FROM r WHERE segment IS NOT NULL AND balance <> 'Prefer not to say' GROUP BY 1), p AS (SELECT a.grp AS a, a.n AS na, a.k AS ka, b.grp AS b, b.n AS nb, b.k AS kb, a.k/a.n::DOUBLE AS pa, b.k/b.n::DOUBLE AS pb FROM c a JOIN c b ON a.grp < b.grp WHERE a.n >= 10 AND b.n >= 10), i AS (SELECT *, " + f"pa - pb - sqrt(pow(pa - {WLO('ka','na')}, 2) + pow({WHI('kb','nb')} - pb, 2)) AS lo, pa - pb + sqrt(pow({WHI('ka','na')} - pa, 2) + pow(pb - {WLO('kb','nb')}, 2)) AS hi, (pa - pb) / sqrt((ka+kb)/(na+nb)::DOUBLE * (1 - (ka+kb)/(na+nb)::DOUBLE) * (1.0/na + 1.0/nb)) AS z FROM p)"


@query("t13_spearman", SQL + f", d AS (SELECT {_SCORE} AS x, CASE balance WHEN 'low' THEN 1 WHEN 'middle' THEN 2 WHEN 'high' THEN 3 END AS y FROM r), q AS (SELECT * FROM d WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM q) SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM k")
def spearman(spark, sf_dir):
    balance = F.when(F.col("balance") == "low", 1).when(F.col("balance") == "middle", 2).when(F.col("balance") == "high", 3)
    cells = respondents(spark, sf_dir).where(ORDERS.ordered_base("priority") & ORDERS.base("balance")).groupBy(estimates.score(ORDERS, "priority").alias("x"), balance.alias("y")).agg(F.count(F.lit(1)).alias("k"))
    return rounded(contrasts.spearman(cells))


_THR = SQL + f", c AS (SELECT grp, count(*) FILTER ({_BB} AND segment = grp) AS n, count(*) FILTER (balance = 'low' AND segment = grp) AS k FROM r, {SEGMENTS} GROUP BY 1)"


@query("t28_stability", _CNT + f""", v AS (SELECT a, b, da, db, lo AS lo0, hi AS hi0, na, nb, ka + da AS ka, kb + db AS kb, (ka+da)/na::DOUBLE AS pa, (kb+db)/nb::DOUBLE AS pb FROM i, (VALUES (-1,0),(1,0),(0,-1),(0,1)) d(da, db) WHERE ka + da BETWEEN 0 AND na AND kb + db BETWEEN 0 AND nb),
w AS (SELECT *, pa - pb - sqrt(pow(pa - {WLO('ka','na')}, 2) + pow({WHI('kb','nb')} - pb, 2)) AS l, pa - pb + sqrt(pow({WHI('ka','na')} - pa, 2) + pow(pb - {WLO('kb','nb')}, 2)) AS h FROM v)
SELECT a, b, bool_and((CASE WHEN l > 0 THEN 'up' WHEN h < 0 THEN 'down' ELSE 'open' END) = (CASE WHEN lo0 > 0 THEN 'up' WHEN hi0 < 0 THEN 'down' ELSE 'open' END)) AS stable, max(CASE WHEN lo0 > 0 THEN 'up' WHEN hi0 < 0 THEN 'down' ELSE 'open' END) AS state FROM w GROUP BY 1, 2""")
def stability(spark, sf_dir):
    f = ORDERS.where("balance", ["low"])
    pairs = contrasts.compare(estimates.counts(respondents(spark, sf_dir), f.universe, f.mask, ORDERS.groups("segment")))
    state = lambda lo, hi: F.when(lo > 0, "up").when(hi < 0, "down").otherwise("open")
    flips = F.array(*[F.struct(F.lit(x).alias("da"), F.lit(y).alias("db")) for x, y in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    v = pairs.select("a", "b", "na", "nb", "ka", "kb", state(F.col("lo"), F.col("hi")).alias("was"), F.inline(flips)).withColumns({"ka": F.col("ka") + F.col("da"), "kb": F.col("kb") + F.col("db")}).where("ka between 0 and na and kb between 0 and nb")
    lo, hi = stats.newcombe(F.col("ka"), F.col("na"), F.col("kb"), F.col("nb"))
    return v.groupBy("a", "b").agg(F.bool_and(state(lo, hi) == F.col("was")).alias("stable"), F.max("was").alias("state"))


@query("t09_mean_tests")
def mean_tests(spark, sf_dir):
    """t intervals of mean scores, a one-sample test against 2.5, and Welch's test of each pair, from (n, mean, sd)."""
    m = estimates.mean_scores(respondents(spark, sf_dir), ORDERS, "priority", "region")
    a, b = m.toDF("a", "na", "ma", "sa"), m.toDF("b", "nb", "mb", "sb")
    va, vb = F.col("sa") ** 2 / F.col("na"), F.col("sb") ** 2 / F.col("nb")
    pairs = a.join(b, F.col("a") < F.col("b")).withColumns({"t": (F.col("ma") - F.col("mb")) / F.sqrt(va + vb), "df": (va + vb) ** 2 / (va**2 / (F.col("na") - 1) + vb**2 / (F.col("nb") - 1)), "d": (F.col("ma") - F.col("mb")) / F.sqrt((F.col("sa") ** 2 + F.col("sb") ** 2) / 2)})
    half = stats.q_t(F.col("na").cast("double") - 1) * F.col("sa") / F.sqrt("na")
    one = (F.col("ma") - 2.5) / (F.col("sa") / F.sqrt("na"))
    return rounded(pairs.withColumns({"p": stats.p_t("t", "df"), "a_lo": F.col("ma") - half, "a_hi": F.col("ma") + half, "p_a_is_2_5": stats.p_t(one, F.col("na").cast("double") - 1)}), 6)
