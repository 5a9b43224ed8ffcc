"""Outcomes of runs, verdicts on them, attempts and checkpoints: from rows of results to rates, faults and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Errors of a parser, and kinds of planted errors that a judge has to be tried on. Fixed names.
SYNTAX = ("SyntaxError", "IndentationError")
PLANTED = ("flip_direction", "drop_contradicting", "inconclusive_as_support", "remove_gap", "append_verdict", "add_causal", "suppressed_value", "unavailable_comparison")


def rate(hits: Column, n: Column) -> Column:
    return hits / F.nullif(n, F.lit(0))


def outcome() -> Column:
    """The one outcome of a result: truncated, syntax_valid, error_type, execution_valid, required (whether a contract asks for analyses), semantics (null: not checked)."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(yes("truncated"), "truncated")
        .when(~yes("syntax_valid"), F.when(F.col("error_type").isin(*SYNTAX), "syntax_error").otherwise("empty_or_invalid_output"))
        .when(~yes("execution_valid"), "execution_error")
        .when(yes("required") & F.col("semantics").isNull(), "semantic_check_unavailable")
        .when(yes("required") & ~F.col("semantics"), "semantic_failure")
        .otherwise("successful")
    )


def outcome_rates(results: DataFrame, by: str) -> DataFrame:
    """(by, examples, syntax_valid_rate, execution_valid_rate, success_rate, measured, measured_pass_rate): results as outcome() reads them; measured are those whose semantics were checked."""
    n = F.count(F.lit(1))
    each = results.withColumn("outcome", outcome()).groupBy(by).agg(n.alias("examples"), F.count_if("syntax_valid").alias("s"), F.count_if("execution_valid").alias("e"), F.count_if(F.col("outcome") == "successful").alias("ok"), F.count("semantics").alias("measured"), F.count_if("semantics").alias("m"))
    return each.select(by, "examples", rate(F.col("s"), F.col("examples")).alias("syntax_valid_rate"), rate(F.col("e"), F.col("examples")).alias("execution_valid_rate"), rate(F.col("ok"), F.col("examples")).alias("success_rate"), "measured", rate(F.col("m"), F.col("measured")).alias("measured_pass_rate"))


def failures(results: DataFrame, by: str) -> DataFrame:
    """(by, kind, name, n): failed results by outcome, errors by type, and by type with the part of their message before a colon."""
    short = F.trim(F.get(F.split(F.coalesce("message", F.lit("")), ":"), F.lit(0)))
    detail = F.concat("error_type", F.lit("/"), F.when(short == "", F.col("error_type")).otherwise(short))
    kinds = {"outcome": F.when(F.col("outcome") != "successful", F.col("outcome")), "exception": F.col("error_type"), "detail": detail}
    long = results.withColumn("outcome", outcome()).select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("name")) for k, x in kinds.items()])))
    return long.where("name is not null").groupBy(by, "kind", "name").agg(F.count(F.lit(1)).alias("n"))


def corpus_metrics(cases: DataFrame, by: str) -> DataFrame:
    """(by, examples, tokens, loss, perplexity, token_accuracy, truncation_rate, error) of cases (nll, tokens, correct, truncated): sums over tokens, not means of cases.

    A loss that isn't a number, as without any token, is the error NonFiniteLoss and has no figure; a perplexity beyond the doubles is infinite.
    """
    each = cases.groupBy(by).agg(F.count(F.lit(1)).alias("examples"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum("nll").alias("nll"), F.sum("correct").alias("correct"), F.count_if("truncated").alias("cut"))
    loss = rate(F.col("nll"), F.col("tokens"))
    finite = loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf"))
    shown = lambda c: F.when(finite, c)
    large = F.when(loss < 700, F.exp(loss)).otherwise(F.lit(float("inf")))
    return each.select(by, "examples", "tokens", shown(loss).alias("loss"), shown(large).alias("perplexity"), shown(rate(F.col("correct"), F.col("tokens"))).alias("token_accuracy"), rate(F.col("cut"), F.col("examples")).alias("truncation_rate"), F.when(finite, "").otherwise("NonFiniteLoss").alias("error"))


def judged_cases(cases: DataFrame, items: DataFrame, checks: DataFrame) -> DataFrame:
    """cases with judge_valid, failed_items, semantic_pass, case_passed and combined_pass.

    cases: (id, valid, ended), ended: whether the answer is there and whole; items: (id, item, critical, passed); checks: (id, check, passed). An invalid judgement has no verdict (null). semantic_pass: all critical
    items passed; case_passed: and all checks, of which there must be one; combined_pass: and the answer ended.
    """
    passed = F.coalesce("passed", F.lit(False))
    of_items = items.groupBy("id").agg(F.array_sort(F.collect_set(F.when(~passed, F.col("item")))).alias("failed"), F.bool_and(passed | ~F.coalesce("critical", F.lit(False))).alias("critical"))  # a checklist
    of_checks = checks.groupBy("id").agg(F.bool_and(passed).alias("checked"))
    joined = cases.join(of_items.hint("merge"), "id", "left").join(of_checks.hint("merge"), "id", "left")
    valid = F.coalesce("valid", F.lit(False))
    semantic = F.coalesce("critical", F.lit(True))
    case = semantic & F.coalesce("checked", F.lit(False))
    out = {"judge_valid": valid, "failed_items": F.when(valid, F.coalesce("failed", F.array().cast("array<string>"))), "semantic_pass": F.when(valid, semantic), "case_passed": F.when(valid, case), "combined_pass": F.when(valid, case & F.coalesce("ended", F.lit(False)))}
    return joined.withColumns(out).drop("failed", "critical", "checked")


def review_summary(judged: DataFrame, by: str) -> DataFrame:
    """(by, examples, valid, invalid, semantic_passed, case_passed, combined_passed) of judged_cases(): invalid judgements are neither passed nor failed, but stay in the examples."""
    return judged.groupBy(by).agg(F.count(F.lit(1)).alias("examples"), F.count_if("judge_valid").alias("valid"), F.count_if(~F.col("judge_valid")).alias("invalid"), *[F.count_if(c).alias(name) for c, name in (("semantic_pass", "semantic_passed"), ("case_passed", "case_passed"), ("combined_pass", "combined_passed"))])


def criterion_failures(cases: DataFrame, items: DataFrame, checks: DataFrame, by: str) -> DataFrame:
    """(by, kind, name, n, failed): criteria by type over valid judgements, and checks by name over all cases; items also have a type."""
    passed = F.coalesce("passed", F.lit(False))

    def counted(rows: DataFrame, kind: str, name: str, of: DataFrame) -> DataFrame:
        # joined on their own, in the order of their cases if they come so: a union would be sorted once more, with wider rows
        joined = rows.select("id", F.col(name).alias("name"), passed.alias("ok")).join(of.select("id", by).hint("merge"), "id")
        return joined.groupBy(by, F.lit(kind).alias("kind"), "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"))

    return counted(items, "criterion", "type", cases.where("valid")).unionByName(counted(checks, "check", "check", cases))


def paired(base: DataFrame, other: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, faults) of two runs over the same records, rows being (source_index, record_id, status).

    pairs: (source_index, record_id, base_status, other_status). faults: (fault, key), and no row if the runs may be compared: a setting that differs
    (settings: run "base" or "other", name, value), an adapter where there must be none or none where there must be one (name "adapter"), a
    record of one run only, a record that a run has twice.
    """
    key = ["source_index", "record_id"]
    side = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("status").alias(f"{name}_status"))
    both = side(base, "base").join(side(other, "other").hint("merge"), key, "full_outer")
    named = F.concat_ws(":", *key)
    rows = both.select(named.alias("key"), F.when(F.col("n_base").isNull(), "only_other").when(F.col("n_other").isNull(), "only_base").when((F.col("n_base") > 1) | (F.col("n_other") > 1), "repeated").alias("fault")).where("fault is not null")
    value = lambda run: F.max(F.when(F.col("run") == run, F.col("value")))
    each = settings.groupBy("name").agg(value("base").alias("a"), value("other").alias("b"))  # a row for each setting
    wrong = each.select(F.col("name").alias("key"), F.when((F.col("name") == "adapter") & F.col("a").isNotNull(), "adapter_in_base").when((F.col("name") == "adapter") & F.col("b").isNull(), "no_adapter").when((F.col("name") != "adapter") & ~F.col("a").eqNullSafe(F.col("b")), "setting_differs").alias("fault")).where("fault is not null")
    return both.where("n_base = 1 and n_other = 1").select(*key, "base_status", "other_status"), rows.unionByName(wrong).select("fault", "key")


def metric_differences(records: DataFrame, metrics: DataFrame) -> DataFrame:
    """(metric, base, other, difference, error) of two runs' metrics (run, metric, value), if both cover the same records (run, record_id).

    Otherwise each row has the error OtherRecords and no difference. A metric that one run lacks is left out. Sides are compared by
    counts and order-free fingerprints, so records aren't joined.
    """
    prints = records.groupBy("run").agg(F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("record_id")), F.sum(F.xxhash64("record_id", F.lit(1)).cast("decimal(38,0)"))).alias("print"))
    same = prints.agg((F.count_distinct("print") == 1) & (F.count(F.lit(1)) == 2)).alias("x").toDF("same")
    value = lambda run: F.max(F.when(F.col("run") == run, F.col("value")))
    each = metrics.groupBy("metric").agg(value("base").alias("base"), value("other").alias("other")).where("base is not null and other is not null").crossJoin(F.broadcast(same))  # one row
    return each.select("metric", "base", "other", F.when(F.col("same"), F.col("base") - F.col("other")).alias("difference"), F.when(F.col("same"), "").otherwise("OtherRecords").alias("error"))


def calibration(controls: DataFrame, required: tuple[str, ...] = PLANTED, detect: float = 0.9, fail: float = 0.05, agree: float = 0.95) -> DataFrame:
    """(measure, n, hits, rate, met) of a judge on controls (id, repeat, error_type, expected_pass, observed_pass, valid).

    detection of each kind of planted error: those that aren't expected to pass and don't; unmodified: those that are and don't, of both
    repeats; self_agreement: second repeats judged like their first; valid: judgements that are; kinds of `required` without a control aren't met; gate: all of it.
    """
    hit = lambda name, n, hits: F.struct(F.lit(name).alias("measure"), n.alias("n"), hits.alias("hits"))
    good, seen = F.coalesce("expected_pass", F.lit(False)), F.col("observed_pass")
    planted = controls.where(~good).groupBy(F.concat(F.lit("detection:"), F.coalesce("error_type", F.lit("?"))).alias("measure")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~seen).alias("hits"))
    asked = controls.sparkSession.createDataFrame([(f"detection:{k}",) for k in required], "measure string")
    planted = asked.join(planted.hint("merge"), "measure", "full_outer").select("measure", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "hits")])
    whole = controls.agg(F.array(hit("unmodified", F.count_if(good), F.count_if(good & ~F.coalesce(seen, F.lit(False)))), hit("valid", F.count(F.lit(1)), F.count_if("valid"))).alias("x")).select(F.inline("x"))
    twice = controls.where(good).groupBy("id").agg(*[F.max(F.when(F.col("repeat") == i, F.struct(seen.cast("int").alias("v")))).alias(f"r{i}") for i in (1, 2)]).where("r1 is not null and r2 is not null")
    agreed = twice.agg(hit("self_agreement", F.count(F.lit(1)), F.count_if(F.col("r1.v") == F.col("r2.v"))).alias("x")).select("x.*")
    rows = planted.unionByName(whole).unionByName(agreed).withColumn("rate", rate(F.col("hits"), F.col("n")))
    m, r = F.col("measure"), F.col("rate")
    met = F.when(F.startswith(m, F.lit("detection:")), r >= detect).when(m == "unmodified", r <= fail).when(m == "self_agreement", r >= agree).otherwise(r >= 1)
    rows = rows.withColumn("met", F.coalesce(met, F.lit(False)))
    gate = rows.agg(F.lit("gate").alias("measure"), F.count(F.lit(1)).alias("n"), F.count_if("met").alias("hits")).withColumn("rate", rate(F.col("hits"), F.col("n"))).withColumn("met", F.col("n") == F.col("hits"))
    return rows.unionByName(gate)


def attempts_summary(attempts: DataFrame, checks: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, reasons) of records that were tried several times.

    attempts: (record_id, split, attempt, accepted, error, valid), checks: (record_id, attempt, check, passed), items: (record_id, attempt, item,
    passed). A record is accepted if its last attempt is. accepted: (split, attempts, records, accepted), by the number of attempts. reasons: (reason, n) of
    the last attempts of others: error; else the checks that failed; else the items that failed in a valid judgement; else judge_invalid.
    """
    last = attempts.groupBy("record_id").agg(F.max("attempt").alias("attempt"), F.count(F.lit(1)).alias("attempts"), F.max_by(F.struct("split", "accepted", "error", "valid"), "attempt").alias("x"))
    last = last.select("record_id", "attempt", "attempts", "x.*").withColumn("ok", F.coalesce("accepted", F.lit(False)))
    accepted = last.groupBy("split", "attempts").agg(F.count(F.lit(1)).alias("records"), F.count_if("ok").alias("accepted"))
    rest = last.where("not ok")
    failed = lambda df, name: df.where(~F.coalesce("passed", F.lit(False))).groupBy("record_id", "attempt").agg(F.collect_set(name).alias(name)).hint("merge")  # noqa: E731  the checks of an attempt
    joined = rest.join(failed(checks, "check"), ["record_id", "attempt"], "left").join(failed(items, "item"), ["record_id", "attempt"], "left")
    why = F.when(F.coalesce("error", F.lit("")) != "", F.array(F.lit("error"))).when(F.col("check").isNotNull(), F.col("check")).when(F.coalesce("valid", F.lit(False)), F.col("item")).otherwise(F.array(F.lit("judge_invalid")))
    return accepted, joined.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def best_checkpoints(checkpoints: DataFrame, by: str) -> DataFrame:
    """(by, tag, step, loss): of each run the eligible checkpoint with the least loss, the earliest of equal ones; losses that are no numbers never win, and a run without an eligible one has a row of nulls."""
    usable = F.coalesce("eligible", F.lit(False)) & F.col("loss").isNotNull() & ~F.isnan("loss")
    best = F.min(F.when(usable, F.struct("loss", "step", "tag"))).alias("x")
    return checkpoints.groupBy(by).agg(best).select(by, "x.tag", "x.step", "x.loss")
