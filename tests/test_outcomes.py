"""Outcomes, verdicts, attempts, pairs and checkpoints, each with planted faults and nulls."""

import math

import pytest
from pyspark.sql import functions as F

from tallywright.operators import outcomes

RESULT = "v string, truncated boolean, syntax_valid boolean, error_type string, message string, execution_valid boolean, required boolean, semantics boolean"


def test_one_outcome_for_each_result(spark):
    rows = [
        (("a", True, False, "SyntaxError", "x: y", False, True, False), "truncated"),
        (("a", False, False, "IndentationError", None, None, None, None), "syntax_error"),
        (("a", None, None, None, None, None, None, None), "empty_or_invalid_output"),
        (("a", False, True, "AnalysisError", " UnknownValue : no", False, True, None), "execution_error"),
        (("b", False, True, None, None, True, True, None), "semantic_check_unavailable"),
        (("b", False, True, None, None, True, True, False), "semantic_failure"),
        (("b", False, True, None, None, True, False, False), "successful"),
        (("b", False, True, None, None, True, True, True), "successful"),
    ]
    df = spark.createDataFrame([r for r, _ in rows], RESULT)
    assert [r.o for r in df.coalesce(1).select(outcomes.outcome().alias("o")).collect()] == [o for _, o in rows]
    rates = {r.v: r for r in outcomes.outcome_rates(df, "v").collect()}
    assert (rates["b"].success_rate, rates["b"].measured, rates["b"].measured_pass_rate, rates["a"].syntax_valid_rate) == (0.5, 3, 1 / 3, 0.25)
    found = {(r.v, r.kind, r.name): r.n for r in outcomes.failures(df, "v").collect()}
    assert found[("a", "detail", "AnalysisError/UnknownValue")] == 1 and found[("a", "detail", "IndentationError/IndentationError")] == 1 and found[("b", "outcome", "semantic_failure")] == 1
    assert sum(n for (_, k, _), n in found.items() if k == "outcome") == 6
    assert outcomes.outcome_rates(df.limit(0), "v").count() == outcomes.failures(df.limit(0), "v").count() == 0


def test_corpus_metrics_weigh_tokens(spark):
    df = spark.createDataFrame([("a", 10.0, 10, 5, True), ("a", 90.0, 30, 30, False), ("none", 5.0, 0, 0, False), ("nan", float("nan"), 3, 1, False), ("big", 9000.0, 9, 0, None), ("null", None, None, None, None)], "v string, nll double, tokens long, correct long, truncated boolean")
    got = {r.v: r for r in outcomes.corpus_metrics(df, "v").collect()}
    a = got["a"]
    assert (a.loss, a.token_accuracy, a.truncation_rate, a.tokens) == (2.5, 35 / 40, 0.5, 40) and a.perplexity == pytest.approx(math.exp(2.5))
    assert [(got[v].error, got[v].loss, got[v].perplexity) for v in ("none", "nan", "null")] == [("NonFiniteLoss", None, None)] * 3
    assert got["big"].loss == 1000 and got["big"].perplexity == float("inf")


def test_case_needs_valid_judging_critical_items_and_checks(spark):
    cases = spark.createDataFrame([(i, "v", i != 1, i != 2) for i in range(8)] + [(9, "v", None, True)], "id int, v string, valid boolean, ended boolean")
    items = spark.createDataFrame([(i, "E1", "E1_direction", True, i != 3) for i in range(8)] + [(i, "E9", "E9_adjustment", False, i != 4) for i in range(8)] + [(5, "E2", "E2", True, None)], "id int, item string, type string, critical boolean, passed boolean")
    checks = spark.createDataFrame([(i, "d1", i != 6) for i in range(10) if i != 7], "id int, check string, passed boolean")
    judged = outcomes.judged_cases(cases, items, checks)
    got = {r.id: (r.judge_valid, r.failed_items, r.semantic_pass, r.case_passed, r.combined_pass) for r in judged.collect()}
    assert got[0] == (True, [], True, True, True) and got[1] == (False, None, None, None, None) and got[2] == (True, [], True, True, False)
    assert got[3] == (True, ["E1"], False, False, False) and got[4] == (True, ["E9"], True, True, True) and got[5] == (True, ["E2"], False, False, False)
    assert got[6] == (True, [], True, False, False) and got[7] == (True, [], True, False, False) and got[9][0] is False
    s = outcomes.review_summary(judged, "v").first()
    assert (s.examples, s.valid, s.invalid, s.semantic_passed, s.case_passed, s.combined_passed) == (9, 7, 2, 5, 3, 2)
    fails = {(r.kind, r.name): (r.n, r.failed) for r in outcomes.criterion_failures(cases, items, checks, "v").collect()}
    assert fails == {("criterion", "E1_direction"): (7, 1), ("criterion", "E9_adjustment"): (7, 1), ("criterion", "E2"): (1, 1), ("check", "d1"): (8, 1)}


def test_pairs_and_their_faults(spark):
    run = lambda rows: spark.createDataFrame(rows, "source_index int, record_id string, status string")
    base = run([(0, "a", "ok"), (1, "b", "ok"), (2, "c", "failed"), (4, "e", "ok")])
    good = spark.createDataFrame([("base", "precision", "bf16"), ("other", "precision", "bf16"), ("other", "adapter", "a")], "run string, name string, value string")
    pairs, faults = outcomes.paired(base, base, good)
    assert pairs.count() == 4 and faults.count() == 0
    bad = spark.createDataFrame([("base", "precision", "bf16"), ("other", "precision", "fp32"), ("base", "limit", "5"), ("base", "adapter", "x"), ("other", "adapter", "y")], "run string, name string, value string")
    pairs, faults = outcomes.paired(base, run([(0, "a", "ok"), (1, "x", "ok"), (2, "c", "ok"), (2, "c", "ok"), (3, "d", "ok"), (4, "e", "ok")]), bad)
    assert {tuple(r) for r in faults.collect()} == {("only_base", "1:b"), ("only_other", "1:x"), ("repeated", "2:c"), ("only_other", "3:d"), ("setting_differs", "precision"), ("setting_differs", "limit"), ("adapter_in_base", "adapter")}
    assert {(r.source_index, r.base_status, r.other_status) for r in pairs.collect()} == {(0, "ok", "ok"), (4, "ok", "ok")}


@pytest.mark.parametrize("fault", [None, "record", "run"])
def test_differences_need_the_same_records(spark, fault):
    ids = [(r, str(i)) for r in ("base", "other") for i in range(20) if not (fault == "record" and (r, i) == ("other", 7)) and not (fault == "run" and r == "other")] + ([("other", "99")] if fault == "record" else [])
    metrics = spark.createDataFrame([("base", "loss", 2.0), ("other", "loss", 0.5), ("base", "only", 1.0)], "run string, metric string, value double")
    got = [tuple(r) for r in outcomes.metric_differences(spark.createDataFrame(ids, "run string, record_id string"), metrics).collect()]
    assert got == [("loss", 2.0, 0.5, None if fault else 1.5, "OtherRecords" if fault else "")]


@pytest.mark.parametrize("fault", [None, "overlooked", "rejects", "disagrees", "invalid", "missing"])
def test_calibration(spark, fault):
    rows = []
    for i in range(40):
        for repeat in (1, 2):
            good = i % 2 == 0
            seen = good and not (fault == "rejects" and i < 6) and not (fault == "disagrees" and repeat == 2 and i in (0, 4))
            seen = seen or fault == "overlooked" and i in (1, 5)
            valid = not (fault == "invalid" and (i, repeat) == (39, 1))
            rows.append((i, repeat, None if good else ("flip", "cause")[i % 4 == 3], good, seen if valid else None, valid))
    df = spark.createDataFrame(rows, "id int, repeat int, error_type string, expected_pass boolean, observed_pass boolean, valid boolean")
    got = {r.measure: r for r in outcomes.calibration(df, ("flip", "cause", *(["gap"] if fault == "missing" else [])), fail=0.1).collect()}
    wrong = {m for m, r in got.items() if not r.met} - {"gate"}
    want = {None: set(), "overlooked": {"detection:flip"}, "rejects": {"unmodified"}, "disagrees": {"self_agreement"}, "invalid": {"valid"}, "missing": {"detection:gap"}}[fault]
    assert wrong == want and got["gate"].met == (not want)


def test_last_attempts(spark):
    attempts = [("a", "train", 1, False, None, True), ("a", "train", 2, True, None, True), ("b", "train", 1, True, None, True), ("c", "test", 1, False, "Timeout", None), ("d", "test", 1, False, None, True), ("e", "test", 1, False, None, True), ("f", "test", 1, None, None, None), ("g", "test", 1, True, None, True), ("g", "test", 2, False, None, True)]
    checks = [("a", 1, "d1", False), ("c", 1, "d1", False), ("d", 1, "d1", False), ("d", 1, "d2", False), ("d", 1, "d3", True), ("g", 1, "d1", False)]
    items = [("d", 1, "E1", False), ("e", 1, "E2", None), ("f", 1, "E1", False), ("g", 2, "E3", False)]
    df = lambda rows, cols: spark.createDataFrame(rows, cols)
    accepted, reasons = outcomes.attempts_summary(df(attempts, "record_id string, split string, attempt int, accepted boolean, error string, valid boolean"), df(checks, "record_id string, attempt int, check string, passed boolean"), df(items, "record_id string, attempt int, item string, passed boolean"))
    assert {tuple(r) for r in accepted.collect()} == {("train", 2, 1, 1), ("train", 1, 1, 1), ("test", 1, 4, 0), ("test", 2, 1, 0)}
    assert {r.reason: r.n for r in reasons.collect()} == {"error": 1, "d1": 1, "d2": 1, "E2": 1, "judge_invalid": 1, "E3": 1}


def test_best_checkpoints(spark):
    rows = [("a", "t1", 1, 0.1, False), ("a", "t2", 2, 0.5, True), ("a", "t3", 3, 0.5, True), ("a", "t4", 4, float("nan"), True), ("b", "t1", 1, None, True), ("b", "t2", 2, 0.2, None)]
    got = {tuple(r) for r in outcomes.best_checkpoints(spark.createDataFrame(rows, "run string, tag string, step int, loss double, eligible boolean"), "run").collect()}
    assert got == {("a", "t2", 2, 0.5), ("b", None, None, None)}
    assert outcomes.best_checkpoints(spark.createDataFrame(rows, "run string, tag string, step int, loss double, eligible boolean").where(F.lit(False)), "run").count() == 0


def test_criteria_join_without_a_union_below(spark):
    cases = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", None)], "id int, variant string, valid boolean")
    items = spark.createDataFrame([(1, "x", False), (1, "x", True), (2, "x", False), (3, "x", True), (9, "x", True), (1, None, None)], "id int, type string, passed boolean")
    checks = spark.createDataFrame([(1, "numbers", True), (2, "numbers", False), (3, "numbers", None)], "id int, check string, passed boolean")
    found = outcomes.criterion_failures(cases, items, checks, "variant")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join") and plan.count("Union") == 1
    assert {tuple(r) for r in found.collect()} == {("a", "criterion", "x", 2, 1), ("a", "criterion", None, 1, 1), ("a", "check", "numbers", 2, 1), ("b", "check", "numbers", 1, 1)}
