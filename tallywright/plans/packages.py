"""Queries of validation, catalogues, answers, audits, families, preparation, files and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.operators import answers, audits, families
from tallywright.operators.numbering import numbered
from tallywright.sources import files
from tallywright.streaming import results

from .estimation import rounded
from .registry import query, table
from .study import ORDERS, SQL, respondents


def records(spark, sf_dir):
    """Turn pairs of conversations as records: a user turn and the assistant turn behind it."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    joined = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")).join(a.hint("merge"), ["conv_id", "turn"])
    r = joined.withColumn("record_id", F.concat("conv_id", F.lit("-"), "turn")).withColumn("family", families.digest(F.lit("family"), F.col("conv_id")))
    return r.withColumn("split", families.owner(F.col("family"), {"train": 0.7, "validation": 0.15, "test": 0.15}))


REC = """WITH rec AS (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output, u.conv_id || '-' || u.turn AS record_id, sha256('["family", "' || u.conv_id || '"]') AS family FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
own AS (SELECT *, ('0x' || substr(family, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM rec), sp AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM own) """


# validation and catalogue
@query("v01_study_invariants", SQL + " SELECT (SELECT count(*) FROM (SELECT respondent_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, count(*) FILTER (priority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW')) AS unknown_answers, count(*) FILTER (ret_a = false OR ret_n = false OR ret_r = false) AS unchecked_boxes FROM r")
def invariants(spark, sf_dir):
    r = respondents(spark, sf_dir)
    bad = r.agg(F.count_if(~F.col("priority").isin(ORDERS.values["priority"])).alias("unknown_answers"), F.count_if((F.col("ret_a") == False) | (F.col("ret_n") == False) | (F.col("ret_r") == False)).alias("unchecked_boxes"))  # noqa: E712
    return audits.repeated(r, "respondent_id").agg(F.count(F.lit(1)).alias("repeated_ids")).crossJoin(F.broadcast(bad))  # one row each


@query("v02_clean_labels", "SELECT part_label, count(*) AS n FROM (SELECT CASE replace(p_type, '’', '''') WHEN 'ECONOMY' THEN 'STANDARD' ELSE replace(p_type, '’', '''') END AS part_label FROM part) GROUP BY 1")
def clean_labels(spark, sf_dir):
    renames = F.create_map(F.lit("ECONOMY"), F.lit("STANDARD"))
    plain = F.translate("p_type", "’", "'")
    return table(spark, sf_dir, "part").groupBy(F.coalesce(F.element_at(renames, plain), plain).alias("part_label")).agg(F.count(F.lit(1)).alias("n"))


@query("v05_constant_columns", SQL + " SELECT variable, count(v) AS answered, count(DISTINCT v) AS kinds, CASE WHEN count(DISTINCT v) <= 1 THEN 'constant' ELSE 'kept' END AS reason FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {v}::VARCHAR AS v FROM r" for v in ("status", "priority", "segment", "region", "balance", "ret_a")) + ") GROUP BY 1")
def constant_columns(spark, sf_dir):
    names = ["status", "priority", "segment", "region", "balance", "ret_a"]
    long = respondents(spark, sf_dir).select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in names])))
    return long.groupBy("variable").agg(F.count("v").alias("answered"), F.count_distinct("v").alias("kinds")).withColumn("reason", F.when(F.col("kinds") <= 1, "constant").otherwise("kept"))


@query("v07_category_order", "SELECT o_orderpriority AS answer, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS position, o_orderpriority = '4-NOT SPECIFIED' AS unranked FROM orders GROUP BY 1")
def category_order(spark, sf_dir):
    scale = F.array(*map(F.lit, ORDERS.scales["priority"]))
    place = F.array_position(scale, F.col("answer")).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("answer")).distinct().select("answer", F.when(place > 0, place).alias("position"), (place == 0).alias("unranked"))


@query("v08_band_bounds", "SELECT c_custkey, try_cast(replace(regexp_extract(band, '([0-9][0-9,]*)', 1), ',', '') AS BIGINT) AS lower_bound FROM (SELECT c_custkey, format('{:,d} to {:,d}', (floor(abs(c_acctbal) / 1000) * 1000)::BIGINT, ((floor(abs(c_acctbal) / 1000) + 1) * 1000)::BIGINT) AS band FROM customer)")
def band_bounds(spark, sf_dir):
    low = F.floor(F.abs("c_acctbal") / 1000) * 1000
    band = F.concat(F.format_number(low, 0), F.lit(" to "), F.format_number(low + 1000, 0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(F.regexp_extract(band, "([0-9][0-9,]*)", 1), ",", "").try_cast("long").alias("lower_bound"))


@query("v10_content_hash", "SELECT p_partkey, sha256('[\"' || p_name || '\", \"' || p_brand || '\", \"' || p_size || '\"]') AS digest FROM part")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", families.digest(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("digest"))


@query("v11_binding_faults", SQL + " SELECT segment AS value, count(DISTINCT label) AS labels FROM (SELECT segment, CASE WHEN segment IN ('BUILDING','MACHINERY') THEN 'heavy' ELSE 'light' END AS label FROM r UNION ALL SELECT segment, 'light' FROM r WHERE segment = 'BUILDING') WHERE segment IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1")
def binding_faults(spark, sf_dir):
    seen = respondents(spark, sf_dir).where("segment is not null").select(F.col("segment").alias("value")).distinct()
    bound = seen.withColumn("label", F.when(F.col("value").isin("BUILDING", "MACHINERY"), "heavy").otherwise("light")).unionByName(seen.where("value = 'BUILDING'").withColumn("label", F.lit("light")))
    return bound.groupBy("value").agg(F.count_distinct("label").alias("labels")).where("labels > 1")


@query("c05_numeric_references", "SELECT p_brand AS id, row_number() OVER (ORDER BY min(p_partkey)) AS reference FROM part GROUP BY 1")
def numeric_references(spark, sf_dir):
    cards = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min("p_partkey").alias("ordinal"))
    return cards.select("id", F.row_number().over(W.orderBy("ordinal")).alias("reference"))


@query("c06_block_defaults", "SELECT p_brand, p_type AS common_type, n, distinct_types FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS rn, count(*) OVER (PARTITION BY p_brand) AS distinct_types FROM part GROUP BY 1, 2) WHERE rn = 1")
def block_defaults(spark, sf_dir):
    each = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    by = W.partitionBy("p_brand")
    return each.withColumns({"rn": F.row_number().over(by.orderBy(F.desc("n"), "first")), "distinct_types": F.count(F.lit(1)).over(by)}).where("rn = 1").select("p_brand", F.col("p_type").alias("common_type"), "n", "distinct_types")


@query("c09_reference_text")
def reference_text(spark, sf_dir):
    """Nation names in a text become numbers, longest names first and whole words only."""
    names = table(spark, sf_dir, "nation").groupBy().agg(F.array_sort(F.collect_list(F.struct(-F.length("n_name"), F.col("n_name").alias("n"), F.col("n_nationkey").alias("k")))).alias("refs"))  # one row of a catalogue
    texts = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws(" of ", "s_name", "n_name").alias("t"))
    return texts.crossJoin(F.broadcast(names)).select("s_suppkey", F.aggregate("refs", F.col("t"), lambda a, r: F.regexp_replace(a, F.concat(F.lit("\\b"), r["n"], F.lit("\\b")), r["k"].cast("string"))).alias("text"))


@query("c12_duplicate_blocks", "SELECT key, count(*) AS blocks FROM (SELECT p_brand, list_sort(list_distinct(list(lower(p_type))))::VARCHAR AS k, md5(array_to_string(list_sort(list_distinct(list(lower(p_type)))), '|')) AS key FROM part GROUP BY 1) GROUP BY 1 HAVING count(*) > 1")
def duplicate_blocks(spark, sf_dir):
    sets = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.lower("p_type"))), "|").cast("binary")).alias("key"))
    return sets.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")


# families
OWN = "SELECT o_orderkey, sha256('[\"orders\", \"' || o_orderkey || '\"]') AS h FROM orders"


@query("g06_owners", f"WITH f AS ({OWN}) SELECT o_orderkey, CASE WHEN ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.8 THEN 'train' WHEN ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.9 THEN 'validation' ELSE 'test' END AS owner, CASE WHEN ('0x' || substr(h, 16, 1))::INT % 2 = 0 THEN 'higher' ELSE 'lower' END AS direction, (('0x' || substr(h, 64, 1))::INT % 8)::INT AS card FROM f")
def owners(spark, sf_dir):
    h = F.col("h")
    f = table(spark, sf_dir, "orders").select("o_orderkey", families.digest(F.lit("orders"), F.col("o_orderkey")).alias("h"))
    return f.select("o_orderkey", families.owner(h, {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("owner"), families.fixed_direction(h).alias("direction"), (F.conv(F.substring(h, 64, 1), 16, 10).cast("int") % 8).alias("card"))


@query("g01_family_inventory", SQL + ", c AS (SELECT DISTINCT 'status' AS variable, status AS answer FROM r UNION SELECT DISTINCT 'priority', priority FROM r) SELECT variable, answer, b AS grouping_variable, k AS kind, sha256('[\"' || variable || '\", \"' || answer || '\", \"' || b || '\", \"' || k || '\"]') AS core FROM c, (VALUES ('segment'),('region'),('status')) g(b), (VALUES ('difference'),('threshold')) t(k) WHERE variable <> b")
def family_inventory(spark, sf_dir):
    r = respondents(spark, sf_dir)
    cards = r.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("answer")) for v in ("status", "priority")]))).distinct()
    grid = cards.withColumn("grouping_variable", F.explode(F.array(*map(F.lit, ("segment", "region", "status"))))).withColumn("kind", F.explode(F.array(F.lit("difference"), F.lit("threshold")))).where("variable <> grouping_variable")
    return grid.withColumn("core", families.digest(F.col("variable"), F.col("answer"), F.col("grouping_variable"), F.col("kind")))


@query("g11_quotas", "WITH c AS (SELECT o_orderpriority AS priority, count(*) AS c, 100.0 * count(*) / sum(count(*)) OVER () AS exact FROM orders GROUP BY 1), w AS (SELECT *, floor(exact) AS whole, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, priority) AS place, 100 - sum(floor(exact)) OVER () AS rest FROM c) SELECT priority, (whole + (place <= rest)::INT)::BIGINT AS quota FROM w")
def quota_table(spark, sf_dir):
    return families.quotas(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")), "priority", 100)


@query("g12_prefix_by_hash", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('11:' || o_orderkey)) AS rn FROM orders) WHERE rn <= 20")
def prefix_by_hash(spark, sf_dir):
    return families.take_by_hash(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 11, F.lit(20))


@query("g13_sample_weights", "SELECT o_orderstatus AS stratum, count(*) AS size, least(count(*), 50) AS taken, round(least(count(*), 50) / count(*)::DOUBLE, 8) AS probability FROM orders GROUP BY 1")
def sample_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("stratum"))
    size = o.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    taken = families.take_by_hash(o, "stratum", "o_orderkey", 5, F.lit(50)).groupBy("stratum").agg(F.count(F.lit(1)).alias("taken"))
    return rounded(size.join(taken, "stratum").withColumn("probability", F.col("taken") / F.col("size")))


_LEX = """WITH d AS (SELECT doc_id, quality, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), w AS (SELECT doc_id, quality, w, count(*) AS k FROM (SELECT doc_id, quality, unnest(ws) AS w FROM d) GROUP BY 1, 2, 3),
n AS (SELECT w, sum(CASE WHEN quality = 1 THEN k ELSE 0 END) AS n1, sum(CASE WHEN quality = 0 THEN k ELSE 0 END) AS n0 FROM w WHERE doc_id % 2 = 0 GROUP BY 1), t AS (SELECT sum(n1) AS t1, sum(n0) AS t0, count(*) AS v FROM n), o AS (SELECT w, ln((n1 + 1) / (t1 + v)::DOUBLE) - ln((n0 + 1) / (t0 + v)::DOUBLE) AS o FROM n, t),
p AS (SELECT ln((count(*) FILTER (quality = 1) + 1) / (count(*) FILTER (quality = 0) + 1)::DOUBLE) AS prior FROM d WHERE doc_id % 2 = 0), s AS (SELECT doc_id, sum(k * o) AS s FROM w JOIN o USING (w) WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT count(*) AS n, round(avg(((coalesce(s, 0) + prior > 0)::INT = quality)::INT), 6) AS accuracy, round(greatest(avg(quality), 1 - avg(quality)), 6) AS majority FROM d LEFT JOIN s USING (doc_id), p WHERE doc_id % 2 = 1"""


@query("g41_lexical_audit", _LEX)
def lexical_audit(spark, sf_dir):
    """Multinomial naive Bayes of quality labels on word counts, learnt on even documents; accuracy on all odd ones against the majority."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null"), "doc_id")
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    words = docs.select("doc_id", "quality", F.explode(found).alias("w")).groupBy("doc_id", "quality", "w").agg(F.count(F.lit(1)).alias("k"))
    of = lambda q: F.sum(F.when(F.col("quality") == q, F.col("k")).otherwise(0))
    n = words.where("doc_id % 2 = 0").groupBy("w").agg(of(1).alias("n1"), of(0).alias("n0"))
    tot = n.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count(F.lit(1)).alias("v"))
    odds = n.crossJoin(F.broadcast(tot)).select("w", (F.ln((F.col("n1") + 1) / (F.col("t1") + F.col("v"))) - F.ln((F.col("n0") + 1) / (F.col("t0") + F.col("v")))).alias("o"))  # one row
    prior = docs.where("doc_id % 2 = 0").agg(F.ln((F.count_if(F.col("quality") == 1) + 1) / (F.count_if(F.col("quality") == 0) + 1)).alias("prior"))
    said = words.where("doc_id % 2 = 1").join(odds.hint("merge"), "w").groupBy("doc_id").agg(F.sum(F.col("k") * F.col("o")).alias("s"))
    judged = docs.where("doc_id % 2 = 1").select("doc_id", "quality").join(said.hint("merge"), "doc_id", "left").crossJoin(F.broadcast(prior))  # one row
    right = (((F.coalesce("s", F.lit(0.0)) + F.col("prior")) > 0).cast("int") == F.col("quality")).cast("int")
    return rounded(judged.agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.greatest(F.avg("quality"), 1 - F.avg("quality")).alias("majority")), 6)


# answers
def packs(spark, sf_dir):
    """An evidence value and a written answer for each nation: its share of customers in debt."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("pack")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k")).withColumn("value", F.col("k") / F.col("n"))
    told = F.when(F.col("pack") % 5 == 0, F.col("value") + 0.3).otherwise(F.col("value"))
    return c.withColumn("answer", F.concat(F.format_string("A share of %.1f%% of %d customers is in debt [s1.r%d].", told * 100, F.col("n"), F.col("pack"))))


@query("k15_case_scores", "SELECT doc_id, quality = 1 AND toxic = 0 AS passed, toxic IS NOT NULL AS valid FROM labels")
def case_scores(spark, sf_dir):
    items = table(spark, sf_dir, "labels").select("doc_id", F.inline(F.array(F.struct(F.lit("quality").alias("item"), (F.col("quality") == 1).alias("ok")), F.struct(F.lit("safe").alias("item"), (F.col("toxic") == 0).alias("ok")))))
    return items.groupBy("doc_id").agg(F.bool_and("ok").alias("passed"), (F.count("ok") == 2).alias("valid"))


@query("k21_outcome_rates", "SELECT event_type AS outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS rate, round(exp(sum(value) / count(*) / 100), 8) AS perplexity FROM events GROUP BY 1")
def outcome_rates(spark, sf_dir):
    each = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.exp(F.sum("value") / F.count(F.lit(1)) / 100).alias("perplexity"))
    return rounded(each.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))))


@query("k24_paired_runs", "WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, 1 - toxic AS quality FROM labels) SELECT a.quality AS base, b.quality AS adapted, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1, 2")
def paired_runs(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    a, b = lab.select("doc_id", F.col("quality").alias("base")), lab.select("doc_id", (1 - F.col("toxic")).alias("adapted"))
    return a.join(b, "doc_id", "full_outer").groupBy("base", "adapted").agg(F.count(F.lit(1)).alias("n"))


@query("k28_blinded_jobs", REC + "SELECT v AS variant, record_id, sha256('[\"' || v || '\", \"' || record_id || '\"]') AS request_id, row_number() OVER (ORDER BY sha256('7' || sha256('[\"' || v || '\", \"' || record_id || '\"]'))) AS place FROM rec, (VALUES ('base'),('adapted')) x(v)")
def blinded_jobs(spark, sf_dir):
    jobs = records(spark, sf_dir).select("record_id", F.explode(F.array(F.lit("base"), F.lit("adapted"))).alias("variant")).withColumn("request_id", families.digest(F.col("variant"), F.col("record_id")))
    return numbered(jobs.withColumn("key", F.sha2(F.concat(F.lit("7"), "request_id"), 256)), "key", name="place").drop("key")


@query("k32_end_to_end_rates", "SELECT coalesce(lang, 'all') AS lang, count(*) AS submitted, count(*) FILTER (quality = 1) AS passed, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 8) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def end_to_end_rates(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(j.rollup("lang").agg(F.count(F.lit(1)).alias("submitted"), F.count_if(F.col("quality") == 1).alias("passed")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "submitted", "passed", (F.col("passed") / F.col("submitted")).alias("rate")))


@query("k37_best_checkpoint", "SELECT event_type, min_by(event_id, value) FILTER (value > 1) AS best, max_by(event_id, ts) AS last FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, value ORDER BY event_id) = 1) GROUP BY 1")
def best_checkpoint(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.withColumn("rn", F.row_number().over(W.partitionBy("event_type", "value").orderBy("event_id"))).where("rn = 1")
    return e.groupBy("event_type").agg(F.min_by("event_id", F.when(F.col("value") > 1, F.struct("value", "event_id"))).alias("best"), F.max_by("event_id", "ts").alias("last"))


# audits
@query("j06_split_leaks", REC + "SELECT kind, key, count(DISTINCT split) AS splits FROM (SELECT 'family' AS kind, family AS key, split FROM sp UNION ALL SELECT 'input', md5(input), split FROM sp) GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, sf_dir):
    return audits.split_leaks(records(spark, sf_dir).withColumn("input_hash", F.md5(F.col("input").cast("binary"))), {"family": "family", "input": "input_hash"})


@query("j03_union_in_order", REC + "SELECT record_id, variant, row_number() OVER (ORDER BY conv_id, turn, variant) AS pos FROM (SELECT *, 0 AS variant FROM sp UNION ALL SELECT *, 1 FROM sp WHERE split = 'train') ")
def union_in_order(spark, sf_dir):
    r = records(spark, sf_dir)
    both = r.withColumn("variant", F.lit(0)).unionByName(r.where("split = 'train'").withColumn("variant", F.lit(1)))
    return numbered(both, "conv_id", "turn", "variant").select("record_id", "variant", "pos")


@query("j04_resume", REC + "SELECT split, count(*) AS pending FROM sp WHERE record_id NOT IN (SELECT record_id FROM rec WHERE conv_id % 3 = 0) GROUP BY 1")
def resume(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.join(r.where("conv_id % 3 = 0").select("record_id").hint("merge"), "record_id", "left_anti").groupBy("split").agg(F.count(F.lit(1)).alias("pending"))


@query("j15_leaked_passages", "SELECT doc_id AS id, item_id AS passage_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)")
def leaked_passages(spark, sf_dir):
    return audits.passages_in(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")))


@query("j16_view_audit", REC + "SELECT 'left' AS side, record_id FROM sp WHERE conv_id % 10 = 3")
def view_audit(spark, sf_dir):
    gold = records(spark, sf_dir).select("record_id", "conv_id", "input")
    view = gold.where("conv_id % 10 <> 3")
    return audits.differences(gold, view).select("side", "record_id")


@query("j18_reference_check", "SELECT count(*) AS groups, 0::BIGINT AS mismatches FROM (SELECT c_mktsegment FROM customer GROUP BY 1)")
def reference_check(spark, sf_dir):
    """Counts of one pass against those of an independent one."""
    c = table(spark, sf_dir, "customer")
    a = c.groupBy("c_mktsegment").agg(F.avg((F.col("c_acctbal") < 0).cast("double")).alias("share"))
    b = c.groupBy("c_mktsegment").agg((F.count_if(F.col("c_acctbal") < 0) / F.count(F.lit(1))).alias("other"))
    return a.join(b, "c_mktsegment").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.abs(F.col("share") - F.col("other")) > 1e-12).alias("mismatches"))


# reports and preparation
@query("a17_tag_diversity", "SELECT dim, tag, count(*) AS n FROM (SELECT 'status' AS dim, o_orderstatus AS tag FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders) GROUP BY 1, 2")
def tag_diversity(spark, sf_dir):
    tags = F.array(F.struct(F.lit("status").alias("dim"), F.col("o_orderstatus").alias("tag")), F.struct(F.lit("priority").alias("dim"), F.col("o_orderpriority").alias("tag")))
    return table(spark, sf_dir, "orders").select(F.inline(tags)).groupBy("dim", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("a20_difficulty_pivot", "SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def difficulty_pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().toDF("priority", "f", "o", "p")


@query("a23_offsets", "SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id) - n_chars)::BIGINT AS start FROM documents")
def offsets(spark, sf_dir):
    """Running offsets by ranges: sums of ranges first, then inside each range."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 1000).alias("range"))
    sums = d.groupBy("range").agg(F.sum("n_chars").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each thousand
    inside = F.coalesce(F.sum("n_chars").over(W.partitionBy("range").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("inside", inside).join(sums.select("range", "before"), "range").select("doc_id", (F.col("before") + F.col("inside")).alias("start"))


@query("f14_subset", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = 1 AND n_chars <= 4000 ORDER BY n_chars DESC, doc_id LIMIT 40)")
def subset(spark, sf_dir):
    """Longest-first report of whole examples under a cap: the limit is the feature."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where("lang = 'en' and n_chars <= 4000").join(good, "doc_id", "left_semi").orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id", "n_chars")


@query("m01_update_windows", REC + ", n AS (SELECT record_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, count(*) OVER () AS total FROM rec) SELECT record_id, (pos * 4 // total)::BIGINT AS quarter, (pos // 16)::BIGINT AS batch FROM n")
def update_windows(spark, sf_dir):
    r = numbered(records(spark, sf_dir), "conv_id", "turn", start=0)
    n = r.crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("total"))))  # one row
    return n.select("record_id", F.floor(F.col("pos") * 4 / F.col("total")).alias("quarter"), F.floor(F.col("pos") / 16).alias("batch"))


@query("m03_messages", "SELECT conv_id, count(*) AS messages, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role FROM conversations GROUP BY 1")
def messages(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return chats.select("conv_id", F.size("m").cast("long").alias("messages"), F.col("m")[0]["role"].alias("first_role"), F.element_at("m", -1)["role"].alias("last_role"))


# files
@query("io09_jsonl_round_trip", REC + "SELECT split, count(*) AS n, sum(length(input))::BIGINT AS chars FROM sp GROUP BY 1")
def jsonl_round_trip(spark, sf_dir):
    at = files.shared_folder(spark, "export")
    files.write_jsonl(records(spark, sf_dir).select("record_id", "input", "output", "split"), at, ["split"])
    return files.read_jsonl(spark, at, "record_id string, input string, output string, split string").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("input")).alias("chars"))


@query("io15_manifest")
def manifest_check(spark, sf_dir):
    """A package, its manifest and the verification against it: no row at fault."""
    at = files.shared_folder(spark, "package")
    records(spark, sf_dir).select("record_id", "input", "split").write.partitionBy("split").json(at)
    from pyspark.sql import DataFrame

    listed: DataFrame = files.manifest(spark, at)
    return listed.join(files.verify(spark, at, listed).select("name", F.lit(True).alias("at_fault")), "name", "left").select("name", F.coalesce("at_fault", F.lit(False)).alias("at_fault"))


# streams
@query("st01_once", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_once(spark, sf_dir):
    """Every event once, although each comes twice, over two runs with one home: the second has nothing to add."""
    home = files.shared_folder(spark, "once")
    twice = lambda: results.events(spark, sf_dir).unionByName(results.events(spark, sf_dir))
    results.append_once(twice(), "event_id", home)
    return results.append_once(twice(), "event_id", home).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("st02_tallies", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tallies(spark, sf_dir):
    done = results.drain(results.tallies(results.events(spark, sf_dir), "ts", "event_type"), "tallies", "update")
    by = W.partitionBy("window", "event_type").orderBy(F.desc("epoch"))
    return done.withColumn("rn", F.row_number().over(by)).where("rn = 1").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st03_ledger", "WITH e AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS print FROM events) SELECT user_id, print, max_by(value, (ts, event_id)) FILTER (event_type = print) AS value, count(*) FILTER (event_type = print) AS accepted, count(*) FILTER (event_type <> print) AS refused FROM e GROUP BY 1, 2")
def request_ledger(spark, sf_dir):
    """Users as requests and kinds of events as fingerprints: the first one stays, other ones are refused, and its latest value counts."""
    home = files.shared_folder(spark, "ledger")
    rows = results.stream_ledger(results.events(spark, sf_dir), "user_id", "ts", "event_type", "event_id", home)
    return results.entries(rows).withColumnRenamed("request", "user_id")
