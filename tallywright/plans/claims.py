"""Queries of resampling tests, claims, checklists, reviews and exported views."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions import stats
from tallywright.operators import contrasts, estimates, families, resampling
from tallywright.sources import files

from .estimation import _BB, _CNT, rounded
from .packages import REC, numeric_references, records
from .registry import query, table
from .study import ORDERS, SQL, respondents


# resampling and strata
def _by_cell(spark, sf_dir, y):
    df = respondents(spark, sf_dir).where(ORDERS.ordered_base("priority") & ORDERS.base("balance") & ORDERS.base("segment") & ORDERS.base("region"))
    return df.groupBy(F.concat_ws("/", "segment", "region", "status").alias("grp"), estimates.score(ORDERS, "priority").alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("k"))


@query("t13_rank_tests")
def rank_tests(spark, sf_dir):
    """Spearman's rho of priority and balance in each segment, region and status, with bootstrap interval and permutation p."""
    balance = F.when(F.col("balance") == "low", 1).when(F.col("balance") == "middle", 2).otherwise(3)
    return rounded(resampling.rank_tests(_by_cell(spark, sf_dir, balance)), 6)


@query("t14_monte_carlo")
def monte_carlo(spark, sf_dir):
    """Independence of priority and balance in each segment, region and status by random tables."""
    return rounded(resampling.independence_tests(_by_cell(spark, sf_dir, F.col("balance"))), 6)


# studies and catalogues
@query("f18_subset_study", SQL + " SELECT respondent_id, status, ret_a, ret_n, ret_r FROM r")
def subset_study(spark, sf_dir):
    """Asking for one checkbox keeps its siblings."""
    return ORDERS.subset(respondents(spark, sf_dir), "respondent_id", ["status", "ret_r"])


REFS = "WITH ref AS (SELECT p_brand AS id, row_number() OVER (ORDER BY min(p_partkey)) AS reference FROM part GROUP BY 1) "


@query("c07_numeric_catalogue", REFS + "SELECT p_partkey, reference, CASE WHEN regexp_matches(p_name, '\\s') THEN p_name END AS label FROM part JOIN ref ON p_brand = id")
def numeric_catalogue(spark, sf_dir):
    """Brands by number; a label stays only if it is more than one word."""
    refs = numeric_references(spark, sf_dir).withColumnRenamed("id", "p_brand")
    return table(spark, sf_dir, "part").join(refs.hint("merge"), "p_brand").select("p_partkey", "reference", F.when(F.col("p_name").rlike("\\s"), F.col("p_name")).alias("label"))


@query("c08_numeric_evidence", REFS + "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(reference))), ',') AS variables FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ref ON p_brand = id GROUP BY 1")
def numeric_evidence(spark, sf_dir):
    """The brands of an order's lines, as numbers."""
    numbered = numeric_catalogue(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "reference")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(numbered.hint("merge"), "l_partkey")
    return lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("reference")).cast("array<string>"), ",").alias("variables"))


@query("c16_record_inputs", REC + "SELECT record_id, CAST(json_object('study', split, 'claim', input) AS VARCHAR) AS analysis_input, CAST(json_object('study', split, 'claim', input, 'program', output) AS VARCHAR) AS synthesis_input FROM sp")
def record_inputs(spark, sf_dir):
    parts = [F.col("split").alias("study"), F.col("input").alias("claim")]
    return records(spark, sf_dir).select("record_id", F.to_json(F.struct(*parts)).alias("analysis_input"), F.to_json(F.struct(*parts, F.col("output").alias("program"))).alias("synthesis_input"))


# candidates and claims
@query("g14_candidate_pairs", "WITH a AS (SELECT p_partkey AS id, p_type AS variable, p_brand AS bucket, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('3:' || p_partkey)) AS rn FROM part), k AS (SELECT * FROM a WHERE rn <= 24), p AS (SELECT x.bucket, x.id AS a, y.id AS b, row_number() OVER (PARTITION BY x.bucket ORDER BY sha256(x.id || '-' || y.id)) AS place FROM k x JOIN k y ON x.bucket = y.bucket AND x.id < y.id AND x.variable <> y.variable) SELECT bucket, a, b FROM p WHERE place <= 60")
def candidate_pairs(spark, sf_dir):
    """Pairs of different variables: the first 60 in hash order of those among a bucket's first 24."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("variable"), F.col("p_brand").alias("bucket"))
    k = families.take_by_hash(part, "bucket", "id", 3, F.lit(24))
    x, y = k.toDF("a", "va", "bucket"), k.toDF("b", "vb", "bucket")
    pairs = x.join(y.hint("merge"), "bucket").where("a < b and va <> vb").withColumn("key", F.concat_ws("-", "a", "b"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy(F.sha2("key", 256)))
    return pairs.withColumn("place", place).where("place <= 60").select("bucket", "a", "b")


@query("g20_atom_keys", "SELECT l_orderkey, count(DISTINCT l_partkey) AS atoms, md5(array_to_string(list_sort(list_distinct(list(sha256('[\"atom\", \"' || l_partkey || '\"]')))), ',')) AS family FROM lineitem GROUP BY 1")
def atom_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(families.digest(F.lit("atom"), F.col("l_partkey")))).alias("keys"))
    return keys.select("l_orderkey", F.size("keys").cast("long").alias("atoms"), F.md5(F.array_join("keys", ",").cast("binary")).alias("family"))


@query("g21_claim_variants", REC + "SELECT record_id, variant, start || input AS claim FROM rec, (VALUES (0, ''), (1, 'Is it true that '), (2, 'Check this: ')) v(variant, start)")
def claim_variants(spark, sf_dir):
    starts = F.array(*map(F.lit, ["", "Is it true that ", "Check this: "]))
    return records(spark, sf_dir).select("record_id", "input", F.posexplode(starts).alias("variant", "start")).select("record_id", "variant", F.concat("start", "input").alias("claim"))


@query("g26_narratives", "SELECT nation, string_agg(line, chr(10) || chr(10) ORDER BY segment) AS narrative FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_mktsegment || ': ' || count(*) FILTER (c_acctbal < 0) || ' of ' || count(*) AS line FROM customer GROUP BY 1, 2) GROUP BY 1")
def narratives(spark, sf_dir):
    each = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.format_string("%s: %d of %d", F.first("c_mktsegment"), F.count_if(F.col("c_acctbal") < 0), F.count(F.lit(1))).alias("line"))
    return each.groupBy("nation").agg(F.array_join(F.array_sort(F.collect_list(F.struct("segment", "line")))["line"], "\n\n").alias("narrative"))


@query("g30_realised_claims", REC + "SELECT record_id, contains(output, string_split(input, ' ')[1]) AND contains(output, coalesce(string_split(input, ' ')[2], '')) AS realised FROM rec")
def realised_claims(spark, sf_dir):
    """Whether the first two words of the question stand in the answer."""
    return records(spark, sf_dir).select("record_id", F.forall(F.slice(F.split("input", " "), 1, 2), lambda w: F.contains(F.col("output"), w)).alias("realised"))


@query("g39_paraphrase_checks", REC + "SELECT record_id, 2 * length(output) BETWEEN length(input) AND 6 * length(input) AS length_ok, lower(trim(output)) <> lower(trim(input)) AS differs, len(list_distinct(regexp_extract_all(output, '[0-9]+'))) - len(list_intersect(list_distinct(regexp_extract_all(output, '[0-9]+')), list_distinct(regexp_extract_all(input, '[0-9]+')))) AS new_numbers FROM rec")
def paraphrase_checks(spark, sf_dir):
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit("[0-9]+"), F.lit(0))
    return records(spark, sf_dir).select("record_id", (2 * F.length("output")).between(F.length("input"), 6 * F.length("input")).alias("length_ok"), (F.lower(F.trim("output")) != F.lower(F.trim("input"))).alias("differs"), F.size(F.array_except(numbers("output"), numbers("input"))).cast("long").alias("new_numbers"))


# facts and reviews
def facts(spark, sf_dir):
    f = ORDERS.where("balance", ["low"])
    counted = estimates.counts(respondents(spark, sf_dir), f.universe, f.mask, ORDERS.groups("segment"))
    says = F.when(F.col("lo") > 0, " is above ").when(F.col("hi") < 0, " is below ").otherwise(" is not clearly different from ")
    found = contrasts.compare(counted).where("lo is not null").select(F.lit("finding").alias("kind"), F.concat("a", says, "b").alias("text"))
    return found.unionByName(counted.where(F.col("n").between(1, stats.SUPPRESS - 1)).select(F.lit("suppressed").alias("kind"), F.concat("grp", F.lit(" has too few answers")).alias("text")))


FACTS = _CNT + ", f AS (SELECT 'finding' AS kind, a || CASE WHEN lo > 0 THEN ' is above ' WHEN hi < 0 THEN ' is below ' ELSE ' is not clearly different from ' END || b AS text FROM i UNION ALL SELECT 'suppressed', grp || ' has too few answers' FROM c WHERE n < 10) "
query("k01_facts", FACTS + "SELECT kind, text FROM f")(facts)


@query("k25_metric_differences", "SELECT lang, count(*) AS n, round(avg(quality), 8) AS base, round(avg(1 - toxic), 8) AS adapted, round(avg(1 - toxic) - avg(quality), 8) AS difference FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1")
def metric_differences(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null and toxic is not null")
    m = j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("base"), F.avg(1 - F.col("toxic")).alias("adapted"))
    return rounded(m.withColumn("difference", F.col("adapted") - F.col("base")))


@query("k26_review_summary", "SELECT coalesce(source, 'all') AS variant, count(*) AS valid, count(*) FILTER (quality = 0) AS failed_quality, count(*) FILTER (toxic = 1) AS failed_safety, count(*) FILTER (quality = 1 AND toxic = 0) AS passed FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND source IS NOT NULL GROUP BY ROLLUP (source)")
def review_summary(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null and toxic is not null and source is not null")
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    rows = j.rollup("source").agg(F.count(F.lit(1)).alias("valid"), F.count_if(bad).alias("failed_quality"), F.count_if(toxic).alias("failed_safety"), F.count_if(~bad & ~toxic).alias("passed"))
    return rows.select(F.coalesce("source", F.lit("all")).alias("variant"), "valid", "failed_quality", "failed_safety", "passed")


@query("k29_self_agreement", "SELECT event_type, count(*) AS pairs, round(avg(((a > 50) = (b > 50))::INT), 8) AS agreement FROM (SELECT event_type, user_id, min_by(value, event_id) AS a, max_by(value, event_id) AS b FROM events GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def self_agreement(spark, sf_dir):
    """The first and the last verdict of each user and kind, and how often both fall on one side."""
    pairs = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min_by("value", "event_id").alias("a"), F.max_by("value", "event_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rounded(pairs.groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.avg(((F.col("a") > 50) == (F.col("b") > 50)).cast("int")).alias("agreement")))


@query("k35_changed_verdicts", "SELECT doc_id, quality = 1 AS old, quality = 1 AND toxic = 0 AS new FROM labels WHERE (quality = 1) IS DISTINCT FROM (quality = 1 AND toxic = 0)")
def changed_verdicts(spark, sf_dir):
    old = F.col("quality") == 1
    return table(spark, sf_dir, "labels").select("doc_id", old.alias("old"), (old & (F.col("toxic") == 0)).alias("new")).where("not (old <=> new)")


@query("k36_last_attempts", "SELECT reason, count(*) AS records, sum(attempts)::BIGINT AS attempts FROM (SELECT user_id, count(*) AS attempts, max_by(event_type, event_id) AS reason FROM events GROUP BY 1) GROUP BY 1")
def last_attempts(spark, sf_dir):
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("event_type", "event_id").alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("records"), F.sum("attempts").alias("attempts"))


# exported views
@query("io12_export_views", REC + "SELECT split, count(*) AS n, count(*) FILTER (split <> 'test') AS with_output FROM sp GROUP BY 1")
def export_views(spark, sf_dir):
    """Files by split, read again; the public view of the test split has no outputs."""
    at = files.shared_folder(spark, "views")
    view = records(spark, sf_dir).select("record_id", "input", F.when(F.col("split") != "test", F.col("output")).alias("output"), "split")
    files.write_jsonl(view, at, ["split"])
    return files.read_jsonl(spark, at, "record_id string, input string, output string, split string").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("output").alias("with_output"))
