"""Queries of studies on disk, features and levels, selections, plans, gates and audits."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions import stats
from tallywright.operators import audits, curriculum, estimates, families, gates, selection, validation
from tallywright.operators.numbering import numbered
from tallywright.sources import files, studies

from .estimation import _BB, rounded
from .packages import OWN, REC, owners, records
from .registry import query, table
from .study import ORDERS, SQL, respondents

# studies on disk
_CARDS = [
    {"id": c, "label": c.replace("_", " "), "block_id": "returns" if c.startswith("ret") else c, "answer_type": "select_all" if c.startswith("ret") else "ordered_scale" if c in ORDERS.scales else "single", "values": ORDERS.values.get(c, ["true", "false"]), "ordered_values": ORDERS.scales.get(c), "flags": [], "denominator_rule": "answered"}
    for c in ("status", "priority", "segment", "ret_a", "ret_n", "ret_r")
]


@query("io01_load_study", SQL + " SELECT 'returns' AS block_id, 'ret_r' AS id, count(*) AS n, count(*) FILTER (ret_a IS NOT NULL OR ret_n IS NOT NULL OR ret_r IS NOT NULL) AS base FROM r UNION ALL SELECT 'segment', 'segment', count(*), count(segment) FROM r UNION ALL SELECT 'priority', 'priority', count(*), count(*) FILTER (priority <> '4-NOT SPECIFIED') FROM r")
def load_study(spark, sf_dir):
    """A study is written as Parquet and JSON, loaded again, and gives its bases by the loaded cards."""
    at = files.shared_folder(spark, "study")
    padded = respondents(spark, sf_dir).withColumn("segment", F.concat(F.lit(" "), "segment", F.lit(" ")))
    padded.write.parquet(f"{at}/answers")
    spark.createDataFrame([(json.dumps({"hash": "x", "study": {"id": "orders"}, "variables": _CARDS}),)], "value string").write.text(f"{at}/metadata")
    df, cards, study = studies.load_study(spark, f"{at}/answers", f"{at}/metadata")
    bases = {"ret_r": study.base("ret_r"), "segment": study.base("segment"), "priority": study.ordered_base("priority")}
    counted = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("id"), F.coalesce(b, F.lit(False)).alias("in_base")) for k, b in bases.items()]))).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_base").alias("base"))
    return cards.select("id", "block_id").join(F.broadcast(counted), "id").select("block_id", "id", "n", "base")  # a row for each id above


@query("c01_resolved_variables", "SELECT l_returnflag || l_linestatus AS asked, count(*) AS times, CASE WHEN l_returnflag || l_linestatus IN ('AF', 'NO') THEN '' ELSE 'UnknownVariable' END AS error FROM lineitem GROUP BY 1")
def resolved(spark, sf_dir):
    """Exact ids are found in a catalogue; any other is an error of its own, not a guess."""
    asks = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("asked"))
    cards = spark.createDataFrame([("AF", "returned, finished"), ("NO", "not returned, open")], "id string, label string")
    return validation.resolve(asks, "asked", cards).groupBy("asked").agg(F.count(F.lit(1)).alias("times"), F.max("error").alias("error"))


@query("v15_sample_contract", "SELECT o_orderpriority AS sample, CASE WHEN count(*) FILTER (x IS NULL OR y IS NULL) > 0 THEN 'NotFinite' WHEN count(*) < 100 THEN 'TooFew' ELSE '' END AS error, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x, o_custkey AS y FROM orders WHERE o_orderpriority <> '2-HIGH' OR o_orderkey % 50 = 0) GROUP BY 1")
def sample_contract(spark, sf_dir):
    """Samples of pairs that a test can't use: a value that is missing or not finite, or too few rows. Both kinds are planted."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority <> '2-HIGH' or o_orderkey % 50 = 0")
    x = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 7 == 0), F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return validation.sample_faults(o.select(F.col("o_orderpriority").alias("sample"), x.alias("x"), F.col("o_custkey").cast("double").alias("y")), "sample", ["x", "y"], 100)


_PRINT = "bit_xor(('0x' || substr(sha256(respondent_id::VARCHAR), 1, 15))::BIGINT)"


@query("a11_population_traces", SQL + f" SELECT 'balance' AS estimate, segment AS grp, count(*) AS n_group, {_PRINT} AS group_print, count(*) FILTER ({_BB}) AS n_base, {_PRINT} FILTER ({_BB}) AS base_print FROM r WHERE segment IS NOT NULL GROUP BY segment")
def traces(spark, sf_dir):
    """Who stands behind each group of an estimate: fingerprints of the group and of its base, from the scan that counts them."""
    return estimates.traces(respondents(spark, sf_dir), ORDERS, "balance", "segment", "respondent_id")


# features and levels
_MAPPED = "trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("c14_study_features", f"""WITH c AS (SELECT p_type AS study, p_brand AS block, {_MAPPED} AS label, p_size > 48 AS routed, p_size % 5 AS kind FROM part), b AS (SELECT study, block, list_sort(list_distinct(list(label)))::VARCHAR AS s, bool_or(routed) AS routed, bool_or(kind = 0) AS boxes FROM c GROUP BY 1, 2), s AS (SELECT study, s, count(*) AS n FROM b GROUP BY 1, 2), l AS (SELECT study, label, count(*) AS n FROM c GROUP BY 1, 2)
SELECT study, (SELECT count(*) FROM b WHERE b.study = t.study) AS block_count, (SELECT count(*) FROM s WHERE s.study = t.study AND n > 1) AS near_duplicate_block_count, (SELECT count(*) FROM b WHERE b.study = t.study AND routed) AS routed_block_count, (SELECT count(*) FROM b WHERE b.study = t.study AND boxes) AS select_all_block_count, count(*) AS variable_count, (SELECT count(*) FROM l WHERE l.study = t.study AND n > 1) AS duplicate_label_group_count, count(DISTINCT kind) AS answer_format_count FROM c t GROUP BY 1""")
def study_features(spark, sf_dir):
    """Seven structural features of each catalogue; part types are the studies and brands the blocks."""
    kind = F.concat(F.lit("kind"), F.col("p_size") % 5)
    cards = table(spark, sf_dir, "part").select(F.col("p_type").alias("study"), F.col("p_brand").alias("block"), F.col("p_name").alias("label"), (F.col("p_size") > 48).alias("routed"), F.when(kind == "kind0", "select_all").otherwise(kind).alias("answer_type"))
    return curriculum.study_features(cards)


_OPS = ["subclaim", "where", "group", "proportion", "mean_score", "compare", "not_measured", "top_box"]


def programs(spark, sf_dir):
    """A program for each order: a call for each line; lines of over 45 pieces recode, odd line numbers over 5 have a threshold."""
    op = F.element_at(F.array(*map(F.lit, _OPS)), ((F.col("l_linenumber") + F.col("l_suppkey")) % 8 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").withColumn("call", F.concat(op, F.lit("('"), "l_returnflag", F.lit("')")))
    recode = F.when(F.col("l_quantity") > 45, F.array("l_returnflag", "l_linestatus"))
    one = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "call"))).alias("calls"), F.collect_list(recode).alias("recodes"), F.count_if(F.col("l_discount") > 0.09).alias("variable_groups"), F.count_if(F.col("l_tax") > 0.07).alias("thresholds"))  # the lines of an order
    return one.select(F.col("l_orderkey").alias("id"), F.array_join(F.transform("calls", lambda x: x["call"]), "\n").alias("program"), F.struct("recodes", "variable_groups", "thresholds", F.size("calls").cast("long").alias("relation_depth")).alias("contract"))


_PROGRAMS = f"""WITH l AS (SELECT l_orderkey AS id, {_OPS}[(l_linenumber + l_suppkey) % 8 + 1] AS op, l_quantity > 45 AS recoded, l_returnflag || '|' || l_linestatus AS recode, l_discount > 0.09 AS defined, l_tax > 0.07 AS bound FROM lineitem),
p AS (SELECT id, count(*) FILTER (op = 'subclaim') AS n_subclaims, count(*) FILTER (op = 'where') AS n_filters, count(*) FILTER (op = 'group') AS n_groups, count(*) FILTER (op IN ('proportion', 'top_box', 'mean_score')) AS n_estimands, count(*) FILTER (op = 'compare') AS n_comparisons, count(*) FILTER (op = 'not_measured') AS n_gap_calls, count(DISTINCT recode) FILTER (recoded) AS n_recodes, count(*) FILTER (defined) AS variable_defined_groups, count(*) FILTER (bound) AS n_threshold_comparisons, count(*) AS relation_depth, array_to_string(list_sort(list_distinct(list(op))), ',') AS api_operations FROM l GROUP BY 1) """


@query("g35_program_features", _PROGRAMS + "SELECT * FROM p")
def program_features(spark, sf_dir):
    """Counts of calls, recodes and thresholds of each program."""
    return programs(spark, sf_dir).select("id", *[c.alias(k) for k, c in curriculum.program_features(F.col("program"), F.col("contract")).items()])


@query("g37_difficulty", _PROGRAMS + "SELECT id, CASE WHEN n_subclaims >= 3 OR (n_estimands >= 2 AND (n_filters > 0 OR variable_defined_groups > 0)) OR (n_gap_calls >= 2 AND n_estimands >= 2) THEN 'high' WHEN n_estimands <= 1 AND n_subclaims <= 1 AND n_filters = 0 AND n_recodes = 0 AND n_gap_calls = 0 THEN 'low' ELSE 'medium' END AS p_level FROM p")
def difficulty(spark, sf_dir):
    """The level of each program by its features."""
    return program_features(spark, sf_dir).select("id", curriculum.p_level().alias("p_level"))


@query("g36_exposed_labels", "WITH s AS (SELECT c_nationkey, count(*) AS variables FROM customer GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Most of the ' || c_mktsegment || ' trade owes.' ELSE 'Most of them owe.' END AS claim, c_mktsegment AS label, c_custkey % 7 <> 0 AS required, variables FROM customer JOIN s USING (c_nationkey)), e AS (SELECT *, required AND contains(' ' || trim(regexp_replace(lower(claim), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' ' || lower(label) || ' ') AS exposed FROM c) SELECT c_custkey, exposed, CASE WHEN NOT required OR exposed OR variables <= 64 THEN 'low' WHEN variables >= 256 THEN 'high' ELSE 'medium' END AS q_level FROM e")
def exposed_labels(spark, sf_dir):
    """Whether a claim says the labels that it needs, and how hard it is to map in a catalogue of its nation's size."""
    c = table(spark, sf_dir, "customer")
    sizes = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("variables"))  # a row for each nation
    claim = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Most of the "), "c_mktsegment", F.lit(" trade owes."))).otherwise("Most of them owe.")
    labels = F.when(F.col("c_custkey") % 7 != 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    e = c.join(F.broadcast(sizes), "c_nationkey").select("c_custkey", "variables", (F.size(labels) > 0).alias("required"), curriculum.label_exposed(claim, labels).alias("exposed"))
    return e.select("c_custkey", "exposed", curriculum.q_level(F.col("required"), F.col("exposed"), F.col("variables")).alias("q_level"))


# selections
NEEDS = {"status=F": 30, "status=P": 10, "priority=1-URGENT": 25, "priority=5-LOW&status=O": 12, "status=P&priority=9-NONE": 3}


def tagged(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("status="), "o_orderstatus"), F.concat(F.lit("priority="), "o_orderpriority")).alias("tags"))


@query("a19_coverage", "WITH q AS (SELECT requirement, minimum::BIGINT AS minimum FROM (VALUES " + ", ".join(f"('{r}', {n})" for r, n in NEEDS.items()) + ") t(requirement, minimum)), t AS (SELECT 'status=' || o_orderstatus AS s, 'priority=' || o_orderpriority AS p FROM orders) SELECT requirement, minimum, count(s) AS attained, count(s) >= minimum AS met FROM q LEFT JOIN t ON len([x for x in string_split(requirement, '&') if x NOT IN (s, p)]) = 0 GROUP BY 1, 2")
def coverage(spark, sf_dir):
    """How many rows meet each requirement, single tags and joint ones, against its minimum."""
    needs = spark.createDataFrame(list(NEEDS.items()), "requirement string, minimum long")
    return curriculum.attained(tagged(spark, sf_dir), needs)


@query("a21_envelope", "WITH d AS (SELECT doc_id % 2 = 0 AS own, unnest(['n_chars', 'n_lines', 'n_words']) AS feature, unnest([n_chars, len(string_split(text, chr(10))), len(string_split(text, ' '))])::DOUBLE AS x FROM documents), t AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM d WHERE own GROUP BY 1) SELECT feature, lo, hi, count(*) AS n, count(*) FILTER (x BETWEEN lo AND hi) AS n_inside FROM d JOIN t USING (feature) WHERE NOT own GROUP BY 1, 2, 3")
def envelope(spark, sf_dir):
    """The ranges of three features in half of the documents, and how many of the others lie inside."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"), F.size(F.split("text", " ")).alias("n_words"))
    return curriculum.envelope(d, ["n_chars", "n_lines", "n_words"], F.col("doc_id") % 2 == 0)


@query("g19_disjoint_selection")
def disjoint_selection(spark, sf_dir):
    """Orders as candidates and their parts as resources: no two selected orders share a part, and minima are met as far as they can be.

    One row for each selected order, and one for each requirement that falls short.
    """
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("cores"))  # the lines of an order
    needs = {r: n for r, n in NEEDS.items() if "9-NONE" not in r}  # nothing has it, and what can't be met ends the selection
    chosen, short = selection.covering(tagged(spark, sf_dir).join(parts.hint("merge"), "id"), needs, 300, 11)
    none = F.lit(None)
    return chosen.select("id", "stratum", none.cast("string").alias("requirement"), none.cast("long").alias("attained")).unionByName(short.select(none.cast("long").alias("id"), none.cast("string").alias("stratum"), "requirement", "attained"))


@query("g02_study_families", SQL + ", c AS (SELECT DISTINCT region AS study, status AS answer FROM r WHERE region IS NOT NULL AND status IS NOT NULL) SELECT study, answer, a, b, sha256('[\"' || study || '\", \"status\", \"' || answer || '\", \"' || a || '\", \"' || b || '\"]') AS core FROM c, (VALUES ('BUILDING', 'MACHINERY'), ('AUTOMOBILE', 'FURNITURE')) d(a, b)")
def study_families(spark, sf_dir):
    """The families of each study by its declared contrasts: the same contrast of two studies is two families."""
    cards = respondents(spark, sf_dir).where("region is not null and status is not null").select(F.col("region").alias("study"), F.col("status").alias("answer")).distinct()
    return families.by_study(cards, "status", [("BUILDING", "MACHINERY"), ("AUTOMOBILE", "FURNITURE")])


@query("g23_plan", f"WITH f AS ({OWN}), o AS (SELECT o_orderkey, ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM f), s AS (SELECT o_orderkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM o), e AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) >= 50 AS executed FROM lineitem GROUP BY 1), j AS (SELECT s.*, coalesce(executed, false) AS executed, row_number() OVER (PARTITION BY split, coalesce(executed, false) ORDER BY sha256('5:' || s.o_orderkey)) AS place FROM s LEFT JOIN e USING (o_orderkey)) SELECT split, count(*) AS families, count(*) FILTER (executed) AS executed, count(*) FILTER (executed AND place <= CASE split WHEN 'train' THEN 400 ELSE 50 END) AS selected FROM j GROUP BY 1")
def plan(spark, sf_dir):
    """A plan in its steps: the inventory, who owns it, what can be executed, and what is selected of that for each split."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_quantity") >= 50).alias("executed"))
    return families.plan(owners(spark, sf_dir).select(F.col("o_orderkey").alias("family"), F.col("owner").alias("split")), lines.select(F.col("o_orderkey").alias("family"), "executed"), {"train": 400, "validation": 50, "test": 50}, 5)


# gates and audits
@query("k31_gate_scope", REC + "SELECT split, CASE WHEN split = 'test' THEN 'OtherRecords' WHEN split = 'validation' THEN 'OtherVersion' ELSE '' END AS error FROM sp GROUP BY 1")
def gate_scope(spark, sf_dir):
    """A gate holds for exactly the records and the version it was made on; here one split lacks a record and one has another version."""
    r = records(spark, sf_dir).select(F.col("split").alias("scope"), "record_id", F.lit("v1").alias("version"))
    first = r.where("scope = 'test'").agg(F.min("record_id").alias("record_id"))  # one row
    gate = r.join(F.broadcast(first), "record_id", "left_anti").withColumn("version", F.when(F.col("scope") == "validation", "v0").otherwise(F.col("version")))
    return gates.scope_faults(gate, r).withColumnRenamed("scope", "split")


@query("k22_response_rates", REC + "SELECT split, count(*) AS examples, count(*) FILTER (output <> '') / count(*)::DOUBLE AS nonempty_response_rate, round(count(*) FILTER (output <> '' AND length(output) <= 1500) / count(*)::DOUBLE, 8) AS generated_output_rate, count(*) FILTER (length(output) > 1500) AS truncated, count(*) FILTER (output = '') AS empty_output FROM sp GROUP BY 1")
def response_rates(spark, sf_dir):
    """Rates of written responses: some text, and text that ended within the budget of characters."""
    r = records(spark, sf_dir).select(F.col("split"), F.col("output"), (F.length("output") <= 1500).alias("ended"))
    return rounded(gates.response_rates(r, "split"))


@query("k18_older_contracts", SQL + f", c AS (SELECT segment AS grp, count(*) FILTER (balance = 'low') / count(*)::DOUBLE AS share FROM r WHERE {_BB} AND segment IS NOT NULL GROUP BY 1) SELECT x.grp AS a, y.grp AS b, CASE WHEN x.grp = 'BUILDING' THEN false ELSE x.share > y.share END AS matched FROM c x JOIN c y ON x.grp <> y.grp")
def older_contracts(spark, sf_dir):
    """Contracts that name groups by their values: a contrast of the same values and direction must be there, in either order of the pair."""
    low = ORDERS.where("balance", ["low"])
    counted = estimates.counts(respondents(spark, sf_dir), low.universe, low.mask, ORDERS.groups("segment")).where("n > 0")
    return gates.older_contracts(counted, skip="BUILDING")


@query("j08_small_suite_audit", REC + ", x AS (SELECT record_id, family, split FROM sp WHERE split <> 'test' UNION ALL (SELECT record_id, family, 'validation' FROM sp WHERE split = 'train' ORDER BY record_id LIMIT 1)) SELECT 'family' AS kind, count(*) AS faults FROM (SELECT family FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1) HAVING count(*) > 0 UNION ALL SELECT 'record', count(*) FROM (SELECT record_id FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1) HAVING count(*) > 0")
def small_suite(spark, sf_dir):
    """A training and validation suite with one training record planted in the other split: identities that cross, by kind."""
    r = records(spark, sf_dir).where("split <> 'test'").select("record_id", "family", "split")
    planted = r.where("split = 'train'").orderBy("record_id").limit(1).withColumn("split", F.lit("validation"))
    found = audits.split_leaks(r.unionByName(planted), {"family": "family", "record": "record_id"})
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("faults"))


@query("j13_benchmark_audit", "SELECT 'leaked_item' AS kind, count(*) AS faults FROM (SELECT DISTINCT item_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text)) HAVING count(*) > 0 UNION ALL SELECT 'repeated_item', count(*) FROM (SELECT text FROM benchmark GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'misaligned_answer', count(*) FROM benchmark WHERE item_id % 10 = 3 HAVING count(*) > 0 UNION ALL SELECT 'hidden_marker', count(*) FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|copyright') HAVING count(*) > 0")
def benchmark_audit(spark, sf_dir):
    """Faults of a benchmark by kind: items that documents hold, repeated items, answers of other items (planted) and marked texts."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    answers = items.select("passage_id", F.when(F.col("passage_id") % 10 == 3, F.lit("other")).otherwise(F.md5("passage")).alias("of"))
    return audits.benchmark_faults(items, docs, answers, ["licen[sc]e", "copyright"])


# batches
@query("m02_token_batches", """WITH RECURSIVE n AS (SELECT conv_id, turn, length(text)::BIGINT AS size, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS win FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY size DESC, conv_id, turn) AS place FROM n),
w AS (SELECT win, place, conv_id, turn, size, 0 AS batch, size AS width, 1 AS held FROM o WHERE place = 1 UNION ALL SELECT o.win, o.place, o.conv_id, o.turn, o.size, CASE WHEN w.held = 8 OR w.width * (w.held + 1) > 20000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.held = 8 OR w.width * (w.held + 1) > 20000 THEN o.size ELSE w.width END, CASE WHEN w.held = 8 OR w.width * (w.held + 1) > 20000 THEN 1 ELSE w.held + 1 END FROM w JOIN o ON o.win = w.win AND o.place = w.place + 1)
SELECT win, conv_id, turn, size, batch FROM w""")
def token_batches(spark, sf_dir):
    """Inside each update window of 16 turns, longest first: a batch grows up to 8 rows while rows times width stay in the budget."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    at = numbered(c, "conv_id", "turn", start=0).withColumn("win", F.floor(F.col("pos") / 16)).drop("pos")
    return curriculum.token_batches(at, "win", ["conv_id", "turn"], 20_000, 8)
