"""Queries of outcomes: each order is a record, its lines are what was checked of it, and its number plants the faults."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.operators import outcomes

from .estimation import rounded
from .registry import query, table

#: The same rows for Spark and DuckDB: results, judged cases, and lines as items with their places.
_RESULT = {
    "truncated": "o_orderkey % 17 = 0", "syntax_valid": "o_orderkey % 13 <> 0", "error_type": "CASE WHEN o_orderkey % 26 = 0 THEN 'SyntaxError' WHEN o_orderkey % 13 = 0 THEN 'EmptyOutput' WHEN o_orderkey % 7 = 0 THEN 'AnalysisError' END",
    "message": "CASE WHEN o_orderkey % 14 = 0 THEN 'UnknownValue: no such answer' WHEN o_orderkey % 26 = 0 THEN '' END", "execution_valid": "o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0", "required": "o_orderkey % 3 <> 0", "semantics": "CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderkey % 5 <> 0 END",
}
_RESULTS = "SELECT o_orderkey AS id, o_orderpriority AS variant, " + ", ".join(f"{x} AS {c}" for c, x in _RESULT.items()) + " FROM orders"
_ITEMS = "SELECT l_orderkey AS id, 'i' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS item, l_returnflag AS type, l_linestatus = 'O' AS critical, l_quantity > 10 AS passed FROM lineitem"
_CASES = "SELECT o_orderkey AS id, o_orderpriority AS variant, o_orderkey % 19 <> 0 AS valid, o_orderkey % 17 <> 0 AS ended FROM orders"
_OUTCOME = "CASE WHEN truncated THEN 'truncated' WHEN NOT syntax_valid THEN CASE WHEN error_type IN ('SyntaxError', 'IndentationError') THEN 'syntax_error' ELSE 'empty_or_invalid_output' END WHEN NOT execution_valid THEN 'execution_error' WHEN required AND semantics IS NULL THEN 'semantic_check_unavailable' WHEN required AND NOT semantics THEN 'semantic_failure' ELSE 'successful' END"


def results(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("variant"), *[F.expr(x).alias(c) for c, x in _RESULT.items()])


def judged(spark, sf_dir):
    """cases, items and checks."""
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")  # the lines of an order
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("i"), F.row_number().over(by)).alias("item"), F.col("l_returnflag").alias("type"), (F.col("l_linestatus") == "O").alias("critical"), (F.col("l_quantity") > 10).alias("passed"))
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    cases = orders.select(key.alias("id"), F.col("o_orderpriority").alias("variant"), (key % 19 != 0).alias("valid"), (key % 17 != 0).alias("ended"))
    checks = orders.select(key.alias("id"), F.inline(F.array(F.struct(F.lit("citations").alias("check"), (key % 11 != 0).alias("passed")), F.struct(F.lit("numbers").alias("check"), (key % 23 != 0).alias("passed")))))
    return cases, items.join(orders.select(key.alias("id")).hint("merge"), "id", "left_semi"), checks


@query("k20_result_outcomes", f"WITH r AS ({_RESULTS}) SELECT id, {_OUTCOME} AS outcome FROM r")
def result_outcomes(spark, sf_dir):
    """One outcome for each result, the first that applies."""
    return results(spark, sf_dir).select("id", outcomes.outcome().alias("outcome"))


@query("k21_result_rates", f"WITH r AS (SELECT *, {_OUTCOME} AS outcome FROM ({_RESULTS})) SELECT variant, count(*) AS examples, round(avg(syntax_valid::INT), 8) AS syntax_valid_rate, round(avg(execution_valid::INT), 8) AS execution_valid_rate, round(avg((outcome = 'successful')::INT), 8) AS success_rate, count(semantics) AS measured, round(avg(semantics::INT), 8) AS measured_pass_rate FROM r GROUP BY 1")
def result_rates(spark, sf_dir):
    return rounded(outcomes.outcome_rates(results(spark, sf_dir), "variant"))


@query("k21_failure_types", f"WITH r AS (SELECT *, {_OUTCOME} AS outcome, trim(split_part(coalesce(message, ''), ':', 1)) AS short FROM ({_RESULTS})), f AS (SELECT variant, unnest(['outcome', 'exception', 'detail']) AS kind, unnest([CASE WHEN outcome <> 'successful' THEN outcome END, error_type, error_type || '/' || CASE WHEN short = '' THEN error_type ELSE short END]) AS name FROM r) SELECT variant, kind, name, count(*) AS n FROM f WHERE name IS NOT NULL GROUP BY 1, 2, 3")
def failure_types(spark, sf_dir):
    return outcomes.failures(results(spark, sf_dir), "variant")


@query("k23_corpus_metrics", "WITH c AS (SELECT l_returnflag AS variant, l_extendedprice / 1000 AS nll, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END AS tokens, CASE WHEN l_returnflag = 'R' THEN 0 ELSE floor(l_quantity * (1 - l_discount))::BIGINT END AS correct, l_linenumber > 5 AS truncated FROM lineitem), s AS (SELECT variant, count(*) AS examples, sum(tokens)::BIGINT AS tokens, sum(nll) / nullif(sum(tokens), 0) AS loss, sum(correct) / nullif(sum(tokens), 0) AS acc, avg(truncated::INT) AS cut FROM c GROUP BY 1) SELECT variant, examples, tokens, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity, round(acc, 6) AS token_accuracy, round(cut, 6) AS truncation_rate, CASE WHEN loss IS NULL THEN 'NonFiniteLoss' ELSE '' END AS error FROM s")
def corpus_metrics(spark, sf_dir):
    """Lines as cases with a loss and tokens, by flag; one flag has no token, so no loss."""
    none = F.col("l_returnflag") == "R"
    cases = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant"), (F.col("l_extendedprice") / 1000).alias("nll"), F.when(none, 0).otherwise(F.col("l_quantity").cast("long")).alias("tokens"), F.when(none, 0).otherwise(F.floor(F.col("l_quantity") * (1 - F.col("l_discount")))).alias("correct"), (F.col("l_linenumber") > 5).alias("truncated"))
    return rounded(outcomes.corpus_metrics(cases, "variant"), 6)


_JUDGED = f"""WITH c AS ({_CASES}), i AS (SELECT * FROM ({_ITEMS}) WHERE id IN (SELECT o_orderkey FROM orders)), k AS (SELECT o_orderkey AS id, unnest(['citations', 'numbers']) AS name, unnest([o_orderkey % 11 <> 0, o_orderkey % 23 <> 0]) AS passed FROM orders),
fi AS (SELECT id, coalesce(list_sort(list(item) FILTER (NOT passed)), []) AS failed, bool_and(passed OR NOT critical) AS crit FROM i GROUP BY 1), fk AS (SELECT id, bool_and(passed) AS checked FROM k GROUP BY 1),
j AS (SELECT c.*, CASE WHEN valid THEN coalesce(failed, []) END AS failed_items, CASE WHEN valid THEN coalesce(crit, true) END AS semantic_pass, CASE WHEN valid THEN coalesce(crit, true) AND checked END AS case_passed, CASE WHEN valid THEN coalesce(crit, true) AND checked AND ended END AS combined_pass FROM c LEFT JOIN fi USING (id) JOIN fk USING (id)) """


@query("k15_judged_cases", _JUDGED + "SELECT id, valid AS judge_valid, array_to_string(failed_items, ',') AS failed_items, semantic_pass, case_passed, combined_pass FROM j")
def judged_cases(spark, sf_dir):
    return outcomes.judged_cases(*judged(spark, sf_dir)).select("id", "judge_valid", F.array_join("failed_items", ",").alias("failed_items"), "semantic_pass", "case_passed", "combined_pass")


@query("k26_judged_summary", _JUDGED + "SELECT variant, count(*) AS examples, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (semantic_pass) AS semantic_passed, count(*) FILTER (case_passed) AS case_passed, count(*) FILTER (combined_pass) AS combined_passed FROM j GROUP BY 1")
def judged_summary(spark, sf_dir):
    return outcomes.review_summary(outcomes.judged_cases(*judged(spark, sf_dir)), "variant")


@query("k26_criterion_failures", _JUDGED + "SELECT variant, kind, name, count(*) AS n, count(*) FILTER (NOT passed) AS failed FROM (SELECT id, 'criterion' AS kind, type AS name, passed FROM i UNION ALL SELECT id, 'check', name, passed FROM k) JOIN c USING (id) WHERE valid OR kind = 'check' GROUP BY 1, 2, 3")
def criterion_failures(spark, sf_dir):
    return outcomes.criterion_failures(*judged(spark, sf_dir), "variant")


@query("k24_run_faults", "WITH b AS (SELECT o_orderkey AS i, 'r' || o_orderkey AS r, o_orderkey % 31 = 0 AS gone, o_orderkey % 37 = 0 AS renamed FROM orders) SELECT 'only_base' AS fault, i || ':' || r AS key FROM b WHERE gone OR renamed UNION ALL SELECT 'only_other', i || ':x' || i FROM b WHERE renamed AND NOT gone UNION ALL SELECT 'repeated', i || ':' || r FROM b WHERE NOT gone AND NOT renamed AND i % 101 = 0 UNION ALL SELECT 'setting_differs', 'precision' UNION ALL SELECT 'no_adapter', 'adapter'")
def run_faults(spark, sf_dir):
    """Two runs over the orders: the second lacks some, names some otherwise, has some twice, and was made with another precision and no adapter."""
    key = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(key.alias("source_index"), F.concat(F.lit("r"), key).alias("record_id"), F.lit("completed").alias("status"))
    other = base.where("source_index % 31 <> 0").withColumn("record_id", F.when(F.col("source_index") % 37 == 0, F.concat(F.lit("x"), "source_index")).otherwise(F.col("record_id")))
    other = other.unionByName(other.where("source_index % 101 = 0 and source_index % 37 <> 0"))
    settings = spark.createDataFrame([("base", "precision", "bf16"), ("other", "precision", "fp32"), ("base", "limit", None), ("other", "limit", None), ("base", "adapter", None), ("other", "adapter", None)], "run string, name string, value string")
    return outcomes.paired(base, other, settings)[1]


@query("k24_paired_outcomes", "SELECT o_orderstatus AS base_status, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS other_status, count(*) AS n FROM orders GROUP BY 1, 2")
def paired_outcomes(spark, sf_dir):
    """How the outcomes of two whole runs over the same records go together."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_index"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderstatus").alias("status"))
    other = base.withColumn("status", F.when(F.col("source_index") % 7 == 0, "F").otherwise(F.col("status")))
    settings = spark.createDataFrame([("other", "adapter", "a1")], "run string, name string, value string")
    pairs, faults = outcomes.paired(base, other, settings)
    if not faults.isEmpty():
        raise ValueError("the runs can't be compared")
    return pairs.groupBy("base_status", "other_status").agg(F.count(F.lit(1)).alias("n"))


@query("k25_run_differences", "SELECT metric, round(a, 6) AS base, round(b, 6) AS other, round(a - b, 6) AS difference, '' AS error FROM (SELECT unnest(['price', 'finished']) AS metric, unnest([avg(o_totalprice), avg((o_orderstatus = 'F')::INT)]) AS a, unnest([avg(o_totalprice * 0.9), avg((o_orderstatus = 'F' OR o_orderkey % 7 = 0)::INT)]) AS b FROM orders)")
def run_differences(spark, sf_dir):
    """Metrics of two runs over the same records, in any order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_totalprice", (F.col("o_orderstatus") == "F").alias("f"))
    rows = o.select(F.lit("base").alias("run"), "record_id", F.col("o_totalprice").alias("price"), F.col("f").cast("int").alias("finished")).unionByName(o.orderBy(F.desc("record_id")).select(F.lit("other").alias("run"), "record_id", (F.col("o_totalprice") * 0.9).alias("price"), (F.col("f") | (F.col("record_id") % 7 == 0)).cast("int").alias("finished")))
    metrics = rows.groupBy("run").agg(F.avg("price").alias("price"), F.avg("finished").alias("finished")).select("run", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("price", "finished")])))
    return rounded(outcomes.metric_differences(rows.select("run", "record_id"), metrics), 6)


_PLANTED_KINDS = [*outcomes.PLANTED[:-1], "other_kind"]


@query(
    "k27_judge_calibration",
    f"""WITH c AS (SELECT o_orderkey AS id, unnest([1, 2]) AS repeat, o_orderkey % 2 = 0 AS good, ({_PLANTED_KINDS!r})[(o_orderkey // 2) % 8 + 1] AS kind FROM orders),
    o AS (SELECT *, CASE WHEN id % 97 = 0 THEN NULL WHEN good THEN id % 40 <> 0 AND NOT (repeat = 2 AND id % 50 = 0) ELSE id % 9 = 1 AND kind = 'add_causal' END AS seen FROM c),
    r AS (SELECT 'detection:' || kind AS measure, count(*) AS n, count(*) FILTER (NOT seen) AS hits FROM o WHERE NOT good GROUP BY 1 UNION ALL SELECT 'detection:{outcomes.PLANTED[-1]}', 0, 0
          UNION ALL SELECT 'unmodified', count(*), count(*) FILTER (NOT coalesce(seen, false)) FROM o WHERE good UNION ALL SELECT 'valid', count(*), count(*) FILTER (id % 97 <> 0) FROM o
          UNION ALL SELECT 'self_agreement', count(*), count(*) FILTER (a = b) FROM (SELECT id, max(seen::INT) FILTER (repeat = 1) AS a, max(seen::INT) FILTER (repeat = 2) AS b FROM o WHERE good GROUP BY 1)),
    m AS (SELECT measure, n, hits, round(hits / nullif(n, 0), 8) AS rate, coalesce(CASE WHEN measure LIKE 'detection:%' THEN hits / nullif(n, 0) >= 0.9 WHEN measure = 'unmodified' THEN hits / nullif(n, 0) <= 0.05 WHEN measure = 'self_agreement' THEN hits / nullif(n, 0) >= 0.95 ELSE hits = n AND n > 0 END, false) AS met FROM r)
    SELECT * FROM m UNION ALL SELECT 'gate', count(*), count(*) FILTER (met), round(count(*) FILTER (met) / count(*), 8), count(*) = count(*) FILTER (met) FROM m""",
)
def judge_calibration(spark, sf_dir):
    """A judge tried on planted errors and on untouched answers, twice each: one kind is missing, one is overlooked at times, some judgements are invalid."""
    key = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(key.alias("id"), (key % 2 == 0).alias("expected_pass"), F.element_at(F.array(*map(F.lit, _PLANTED_KINDS)), (F.floor(key / 2) % 8 + 1).cast("int")).alias("error_type"), F.explode(F.array(F.lit(1), F.lit(2))).alias("repeat"))
    passes = F.when(F.col("expected_pass"), (F.col("id") % 40 != 0) & ~((F.col("repeat") == 2) & (F.col("id") % 50 == 0))).otherwise((F.col("id") % 9 == 1) & (F.col("error_type") == "add_causal"))
    controls = c.withColumn("valid", F.col("id") % 97 != 0).withColumn("observed_pass", F.when(F.col("valid"), passes))
    return rounded(outcomes.calibration(controls))


_TRIES = "SELECT l_orderkey AS record_id, i AS attempt, n, i = n AND l_orderkey % 3 <> 0 AS accepted, CASE WHEN l_orderkey % 5 = 0 THEN 'Timeout' END AS error, l_orderkey % 9 <> 0 AS valid, l_quantity, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


@query("k36_rejection_reasons", f"WITH t AS (SELECT * FROM ({_TRIES}) WHERE attempt = n AND NOT accepted), r AS (SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN l_quantity <= 10 THEN 'numbers' WHEN NOT valid THEN 'judge_invalid' WHEN l_discount > 0.05 THEN 'E1' END AS reason FROM t) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def rejection_reasons(spark, sf_dir):
    """Lines as attempts at their order: why the last one of each rejected order failed."""
    return outcomes.attempts_summary(*tries(spark, sf_dir))[1]


@query("k36_attempts_to_accept", f"SELECT 'train' AS split, n AS attempts, count(*) AS records, count(*) FILTER (accepted) AS accepted FROM ({_TRIES}) WHERE attempt = n GROUP BY 2")
def attempts_to_accept(spark, sf_dir):
    return outcomes.attempts_summary(*tries(spark, sf_dir))[0]


def tries(spark, sf_dir):
    by = W.partitionBy("l_orderkey")  # the lines of an order
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).alias("attempt"), F.count(F.lit(1)).over(by).alias("n"), "l_quantity", "l_discount")
    key = F.col("record_id")
    attempts = lines.select("record_id", F.lit("train").alias("split"), "attempt", ((F.col("attempt") == F.col("n")) & (key % 3 != 0)).alias("accepted"), F.when(key % 5 == 0, "Timeout").alias("error"), (key % 9 != 0).alias("valid"))
    return attempts, lines.select("record_id", "attempt", F.lit("numbers").alias("check"), (F.col("l_quantity") > 10).alias("passed")), lines.select("record_id", "attempt", F.lit("E1").alias("item"), (F.col("l_discount") <= 0.05).alias("passed"))


@query("k37_best_checkpoints", "SELECT user_id AS run, first(event_id ORDER BY value, event_id) FILTER (event_type <> 'error') AS tag, first(event_id ORDER BY value, event_id) FILTER (event_type <> 'error') AS step, min(value) FILTER (event_type <> 'error') AS loss FROM events GROUP BY 1")
def best_checkpoints(spark, sf_dir):
    """Events as checkpoints of their user's run, errors not being eligible."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("tag"), F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("event_type") != "error").alias("eligible"))
    return outcomes.best_checkpoints(e, "run")
