import math

import pytest
from pyspark.sql import functions as F

from tallywright.functions import stats
from tallywright.operators import contrasts, estimates
from tallywright.operators.filters import Study


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_published_intervals(spark):
    lo, hi = stats.wilson(F.lit(1045), F.lit(2007))
    a, b = stats.newcombe(F.lit(163), F.lit(258), F.lit(37), F.lit(289))
    assert list(one(spark, lo, hi)) == pytest.approx([0.498817, 0.542489], abs=1e-4)
    assert list(one(spark, a, b)) == pytest.approx([0.4293578, 0.5695578], abs=1e-5)


def test_holm(spark):
    df = spark.createDataFrame([(1, "p", 0.01), (2, "p", 0.03), (3, "p", 0.04), (4, "p", None)], "id int, pack string, p double")
    out = {r.id: r.h for r in df.withColumn("h", stats.holm(F.col("p"), ["pack"], ["id"])).collect()}
    assert [out[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.06, 0.06]) and out[4] is None


def test_tails():
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.t_quantile(0.025, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert stats.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert stats.chi2_sf(18.307038053, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.fisher(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    exact = sum(math.comb(10, i) for i in range(3)) / 1024
    assert stats.binomial_two_sided(2, 10, 0.5) == pytest.approx(2 * exact, abs=1e-12)


BUS = Study(blocks={"days": ["mon", "tue", "wed"]}, scales={"rating": ["poor", "fair", "good"]}, values={"rating": ["poor", "fair", "good", "no view"], "ticket": ["single", "pass"]})


def riders(spark):
    """27 riders: nine ticked Monday, six Tuesday, none Wednesday; twelve ticked nothing at all."""
    rows = [(i, True if i % 3 == 0 else None, True if i % 9 in (1, 4) else None, None, ["poor", "fair", "good", "no view", None][i % 5], ["single", "pass", None][i % 3 if i < 20 else 2]) for i in range(27)]
    return spark.createDataFrame(rows, "rider int, mon boolean, tue boolean, wed boolean, rating string, ticket string")


def test_bases_of_boxes_and_scales(spark):
    df = riders(spark)
    assert (r := estimates.proportion(df, BUS, "mon", True).first()).n == 15 and r.value == pytest.approx(9 / 15)
    assert estimates.proportion(df, BUS, "wed", True).first().numerator == 0
    top = estimates.top_box(df, BUS, "rating", 1).first()
    assert top.n == sum(i % 5 < 3 for i in range(27)) and top.value == pytest.approx(sum(i % 5 == 2 for i in range(27)) / top.n)


def test_or_needs_both_answers(spark):
    """A rider whose ticket is unknown isn't selected by the other side of an "or", and doesn't count as not selected."""
    either = BUS.where("mon", [True]) | BUS.where("ticket", ["pass"])
    got = {r.rider: r for r in riders(spark).select("rider", either.mask.alias("m"), either.universe.alias("u")).collect()}
    ticked = {i for i in range(27) if i % 3 == 0 or i % 9 in (1, 4)}
    assert {i for i, r in got.items() if r.u} == {i for i in ticked if i < 20 and i % 3 != 2}
    assert {i for i, r in got.items() if r.m} == {i for i in ticked if i < 20 and i % 3 != 2 and (i % 3 == 0 or i % 3 == 1)}


def test_suppression_and_flags(spark):
    rows = spark.createDataFrame([("a", 9, 4), ("b", 0, 0), ("c", 40, 3), ("d", 20, 10)], "grp string, n long, k long")
    out = {r.grp: r for r in estimates.shares(rows).collect()}
    assert out["a"].value is None and out["a"].flags == "small_n,suppressed"
    assert out["b"].flags == "small_n,empty_segment" and out["c"].flags == "sparse_count" and out["d"].flags == "small_n"


def test_unknown_value_and_overlap():
    with pytest.raises(ValueError, match="UnknownValue"):
        BUS.where("ticket", ["yearly"])
    with pytest.raises(ValueError, match="GroupsOverlap"):
        BUS.groups("ticket", {"a": ["pass"], "b": ["pass", "single"]})


def test_trend_equals_row_level(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 4, 200), rng.normal(size=200)
    y = y + 0.3 * x
    X = np.column_stack((np.ones(200), x))
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = (y - X @ b) / (1 - np.einsum("ij,jk,ik->i", X, inv, X))
    se = math.sqrt((inv @ (X.T * e**2) @ X @ inv)[1, 1])
    df = spark.createDataFrame([(int(a), float(c)) for a, c in zip(x, y, strict=True)], "position int, y double")
    r = contrasts.trend(df.groupBy("position").agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("ss"))).first()
    assert (r.slope, r.se) == (pytest.approx(b[1]), pytest.approx(se))


def test_rank_tests(spark):
    from tallywright.operators.resampling import rank_tests

    cells = [("a", 1, 1, 30), ("a", 1, 2, 10), ("a", 2, 1, 10), ("a", 2, 2, 30), ("flat", 1, 1, 10), ("flat", 1, 2, 10), ("none", 1, 1, 5), ("none", 1, 2, 5), ("none", 2, 1, 5), ("none", 2, 2, 5)]
    out = {r.grp: r for r in rank_tests(spark.createDataFrame(cells, "grp string, x int, y int, k long")).collect()}
    assert out["a"].rho == pytest.approx(0.5) and out["a"].lo < 0.5 < out["a"].hi and out["a"].p < 0.001
    assert out["flat"].rho is None and out["flat"].n == 20 and out["none"].rho == pytest.approx(0) and out["none"].p == 1.0


def test_random_tables_and_independence(spark):
    import numpy as np

    from tallywright.operators.resampling import independence_tests, random_tables

    t = random_tables(np.array([3, 5, 2]), np.array([4, 6]), 4000, np.random.default_rng(1))
    assert (t.sum(2) == [3, 5, 2]).all() and (t.sum(1) == [4, 6]).all() and t.min() >= 0
    assert t.mean(0) == pytest.approx(np.outer([3, 5, 2], [4, 6]) / 10, abs=0.06)
    cells = [("small", "a", "x", 3), ("small", "a", "y", 1), ("small", "b", "x", 1), ("small", "b", "y", 3), ("odd", "a", "x", 4), ("odd", "b", "y", 4), ("odd", "c", "y", 4), ("flat", "a", "x", 9)]
    out = {r.grp: r for r in independence_tests(spark.createDataFrame(cells, "grp string, x string, y string, k long")).collect()}
    assert out["small"].method == "fisher" and out["small"].p == pytest.approx(0.4857142857)
    assert out["odd"].method == "random" and out["odd"].p < 0.01 and out["flat"].p is None


def test_breslow_day(spark):
    equal = spark.createDataFrame([(20, 10, 10, 20), (40, 20, 20, 40)], "a int, b int, c int, d int")
    apart = spark.createDataFrame([(20, 10, 10, 20), (20, 40, 40, 20)], "a int, b int, c int, d int")
    assert contrasts.breslow_day(equal).first().statistic == pytest.approx(0, abs=1e-9)
    assert contrasts.breslow_day(apart).first().statistic > 10


def test_subset_keeps_siblings(spark):
    assert BUS.subset(riders(spark), "rider", ["tue", "ticket"]).columns == ["rider", "mon", "tue", "wed", "ticket"]


def test_thresholds(spark):
    """Few expected on one side: exact interval and test, which agree on what is clear; else Wilson and score."""
    rows = spark.createDataFrame([("a", 40, 0), ("b", 40, 12), ("c", 400, 60), ("d", 9, 3), ("e", 30, 30)], "grp string, n long, k long")
    out = {r.grp: r for r in contrasts.against(rows, 0.1, ">").collect()}
    assert out["a"].test == "exact_binomial" and out["c"].test == "score_z" and out["d"].label == "unavailable" and out["d"].p is None
    assert out["a"].hi == pytest.approx(1 - 0.025 ** (1 / 40) - 0.1, abs=1e-9) and out["e"].hi == pytest.approx(0.9)
    for r in out.values():
        assert r.p is None or (r.p < 0.05) == (not r.lo <= 0 <= r.hi)
    assert out["b"].label == out["c"].label == "consistent"
    with pytest.raises(ValueError, match="WrongThreshold"):
        contrasts.against(rows, 1.0)
    with pytest.raises(ValueError, match="WrongExpectation"):
        contrasts.compare(rows, "higher")


def test_labels(spark):
    rows = [(0.1, 0.2, ">"), (0.1, 0.2, "<"), (0.1, 0.2, "!="), (-0.1, 0.2, "!="), (-0.2, -0.1, "<"), (None, None, ">"), (0.1, 0.2, None), (0.0, 0.2, ">")]
    got = [r[0] for r in spark.createDataFrame(rows, "lo double, hi double, e string").select(stats.contrast_label(F.col("lo"), F.col("hi"), F.col("e"))).collect()]
    assert got == ["consistent", "inconsistent", "consistent", "no_clear_difference", "consistent", "unavailable", "not_tested", "no_clear_difference"]
    rows = [(1, 0.01, ">"), (-1, 0.01, ">"), (-1, 0.01, "!="), (None, 0.01, ">"), (1, 0.05, ">"), (1, None, ">"), (1, 0.01, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "d int, p double, e string").select(stats.holm_label(F.col("d"), F.col("p"), F.col("e"))).collect()]
    assert got == ["consistent", "inconsistent", "consistent", "no_clear_difference", "no_clear_difference", "unavailable", "not_tested"]


def test_pooled_odds(spark):
    one = spark.createDataFrame([(30, 10, 15, 25), (40, 20, 22, 38), (3, 1, 2, 1)], "a int, b int, c int, d int")
    r = contrasts.mantel_haenszel(one, ">").first()
    gap = sum(a - (a + b) * (a + c) / (a + b + c + d) for a, b, c, d in [(30, 10, 15, 25), (40, 20, 22, 38)])
    var = sum((a + b) * (c + d) * (a + c) * (b + d) / ((n := a + b + c + d) ** 2 * (n - 1)) for a, b, c, d in [(30, 10, 15, 25), (40, 20, 22, 38)])
    assert (r.strata, r.dropped, r.label) == (2, 1, "consistent") and r.p == pytest.approx(math.erfc(abs(gap) / math.sqrt(var) / math.sqrt(2)))
    none = contrasts.mantel_haenszel(spark.createDataFrame([(30, 0, 15, 25)], one.schema), ">").first()
    assert none.odds_ratio is None and none.label == "unavailable" and none.p is None


def test_pooled_odds_of_large_strata(spark):
    big = 3_000_000_000
    one = spark.createDataFrame([(3 * big, big, 2 * big, big), (2 * big, big, big, 2 * big)], "a long, b long, c long, d long")
    small = spark.createDataFrame([(3000, 1000, 2000, 1000), (2000, 1000, 1000, 2000)], one.schema)
    large, few = (contrasts.mantel_haenszel(x, "!=").first() for x in (one, small))
    assert large.odds_ratio == pytest.approx(few.odds_ratio) and large.crude == pytest.approx(few.crude) == 5 * 3 / (2 * 3)
    assert contrasts.breslow_day(one).first().statistic == pytest.approx(contrasts.breslow_day(small).first().statistic * big / 1000)


def test_pooled_odds_of_large_strata_by_spec(spark):
    one = spark.createDataFrame([("p1", ">", 90_000, 30_000, 60_000, 30_000), ("p2", "<", 30_000, 90_000, 60_000, 30_000)], "spec_id string, expect string, a long, b long, c long, d long")
    found = {r.spec_id: r for r in contrasts.mantel_haenszel(one, F.col("expect"), ["spec_id", "expect"]).collect()}
    assert found["p1"].odds_ratio == pytest.approx(1.5) and found["p2"].odds_ratio == pytest.approx(1 / 6) and {r.label for r in found.values()} == {"consistent"}


def test_large_counts_take_no_exact_test(spark):
    from time import monotonic

    rows = spark.createDataFrame([("a", 40_000_000, 15_000_000), ("b", 40_000_000, 15_002_000), ("c", 40, 1)], "grp string, n long, k long")
    compared, held = contrasts.compare(rows, ">"), contrasts.against(rows, 0.4, "<")
    spark.createDataFrame([("a", 40, 1), ("b", 40, 2)], "grp string, n long, k long").transform(contrasts.compare).collect()  # workers are there
    begun = monotonic()
    found = {(r.a, r.b): r for r in compared.collect()}
    assert monotonic() - begun < 15  # the exact test of the first pair alone has thirty million tables
    assert {k: r.test for k, r in found.items()} == {("a", "b"): "pooled_z", ("a", "c"): "pooled_z", ("b", "c"): "pooled_z"}
    assert found["a", "b"].p == pytest.approx(math.erfc(abs(found["a", "b"].z) / math.sqrt(2)))
    assert {r.grp: r.test for r in held.collect()} == dict.fromkeys("abc", "score_z")
