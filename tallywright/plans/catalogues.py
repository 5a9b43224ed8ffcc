"""Queries of study metadata, catalogues, candidates, cases and publishing."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions.stats import REFUSAL
from tallywright.operators import audits, families
from tallywright.sources import files

from .claims import REFS
from .packages import OWN, REC, family_inventory, numeric_references, records
from .registry import query, table
from .study import ORDERS, SQL, respondents

#: Texts that a Python worker folds at a time.
FOLDED = 256
NAMES = ["status", "priority", "segment", "region", "balance", "ret_a", "ret_n", "ret_r"]
_LONG = " UNION ALL ".join(f"SELECT '{v}' AS variable, {v}::VARCHAR AS v, {'(ret_a IS NOT NULL OR ret_n IS NOT NULL OR ret_r IS NOT NULL)' if v in ORDERS.block_of else v + f' IS NOT NULL AND {v} <> ' + repr(REFUSAL)} AS base FROM r" for v in NAMES)


def answers_long(spark, sf_dir) -> DataFrame:
    """(variable, v, base): a row for each respondent and variable."""
    return respondents(spark, sf_dir).select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("v"), ORDERS.base(v).alias("base")) for v in NAMES])))


# metadata
@query("v04_key_integrity", "SELECT 'repeated' AS fault, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'without lines', (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) UNION ALL SELECT 'without order', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders))")
def key_integrity(spark, sf_dir):
    """Repeated keys of orders, and keys that only orders or only lines have."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("l")).unionByName(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit(0).alias("o"), F.lit(1).alias("l")))
    each = keys.groupBy("key").agg(F.sum("o").alias("o"), F.sum("l").alias("l"))
    n = each.agg(F.count_if(F.col("o") > 1).alias("a"), F.count_if((F.col("o") > 0) & (F.col("l") == 0)).alias("b"), F.count_if((F.col("o") == 0) & (F.col("l") > 0)).alias("c"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(c).alias("n")) for k, c in (("repeated", "a"), ("without lines", "b"), ("without order", "c"))])))


@query("v06_typed_variables", SQL + f", l AS ({_LONG}) SELECT variable, CASE WHEN variable LIKE 'ret_%' THEN 'checkbox' WHEN variable = 'priority' THEN 'ordered_scale' ELSE 'single_choice' END AS answer_type, coalesce(string_agg(DISTINCT v, '|' ORDER BY v) FILTER (v <> '{REFUSAL}'), '') AS answers, concat_ws(',', CASE WHEN bool_or(v = '{REFUSAL}') THEN 'has_refusals' END, CASE WHEN bool_or(v IS NULL) THEN 'has_nulls' END) AS flags, count(*) FILTER (base) AS answered FROM l GROUP BY 1")
def typed_variables(spark, sf_dir):
    """Type, answers and flags of each variable from what respondents gave."""
    v = F.col("v")
    kind = F.when(F.col("variable").isin(list(ORDERS.block_of)), "checkbox").when(F.col("variable").isin(list(ORDERS.scales)), "ordered_scale").otherwise("single_choice")
    seen = answers_long(spark, sf_dir).groupBy("variable").agg(F.array_sort(F.collect_set(F.when(v != REFUSAL, v))).alias("answers"), F.bool_or(v == REFUSAL).alias("r"), F.bool_or(v.isNull()).alias("n"), F.count_if("base").alias("answered"))  # answers are of a codebook's size
    return seen.select("variable", kind.alias("answer_type"), F.array_join("answers", "|").alias("answers"), F.concat_ws(",", F.when(F.col("r"), "has_refusals"), F.when(F.col("n"), "has_nulls")).alias("flags"), "answered")


@query("v09_study_caveats", "SELECT nation, 'Refusals in ' || string_agg(segment, ', ' ORDER BY segment) || '.' AS caveat FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer GROUP BY 1, 2 HAVING bool_or(c_acctbal < 0)) GROUP BY 1")
def study_caveats(spark, sf_dir):
    """One sentence for each study that names the blocks with a flag."""
    cards = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("block")).agg(F.collect_set(F.when(F.col("c_acctbal") < 0, "refusals")).alias("flags"))
    named = cards.where(F.array_contains("flags", "refusals")).groupBy("nation").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    return named.select("nation", F.concat(F.lit("Refusals in "), F.array_join("blocks", ", "), F.lit(".")).alias("caveat"))


@query("v12_known_bindings", "SELECT l_orderkey FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey GROUP BY 1 HAVING bool_and(p_partkey IS NOT NULL)")
def known_bindings(spark, sf_dir):
    """Bindings (orders) whose every value (part) is in the catalogue of smaller parts."""
    catalogue = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(catalogue.hint("merge"), "l_partkey", "left")
    return lines.groupBy("l_orderkey").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("ok")).where("ok").select("l_orderkey")


@query("v13_unknown_bindings", "SELECT l_partkey, count(*) AS uses FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1")
def unknown_bindings(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey")).hint("merge"), "l_partkey", "left_anti")


# catalogues
@query("c04_described_variables", SQL + f", l AS ({_LONG}) SELECT variable, CAST(json_object('id', variable, 'recorded', count(v), 'base', count(*) FILTER (base)) AS VARCHAR) AS card FROM l GROUP BY 1")
def described_variables(spark, sf_dir):
    each = answers_long(spark, sf_dir).groupBy("variable").agg(F.count("v").alias("recorded"), F.count_if("base").alias("base"))
    return each.select("variable", F.to_json(F.struct(F.col("variable").alias("id"), "recorded", "base")).alias("card"))


@query("c10_normal_text")
def normal_text(spark, sf_dir):
    """Texts in NFKC, case-folded, as word tokens joined by a space; null is empty."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FOLDED):  # of a batch of Arrow only so many texts are Python's at a time
                some = batch.slice(at, FOLDED)
                texts = [unicodedata.normalize("NFKC", t).casefold() for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(folded, docs.schema).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), " ").alias("text"))


@query("c13_routed_blocks", "WITH n AS (SELECT string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS note FROM part WHERE p_size = 50) SELECT p_brand, coalesce(contains(any_value(note), p_brand || ';'), false) OR bool_or(p_type = 'PROMO' AND p_size = 1) AS routed FROM part LEFT JOIN n ON true GROUP BY 1")
def routed_blocks(spark, sf_dir):
    """Blocks that a study's note names, or that a card flags."""
    part = table(spark, sf_dir, "part")
    note = part.where("p_size = 50").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "; ").alias("note"))  # one row of block names
    flagged = part.groupBy("p_brand").agg(F.bool_or((F.col("p_type") == "PROMO") & (F.col("p_size") == 1)).alias("flag"))
    return flagged.crossJoin(F.broadcast(note)).select("p_brand", (F.contains("note", F.concat("p_brand", F.lit(";"))) | F.col("flag")).alias("routed"))


@query("c15_study_specification", REFS + "SELECT p_brand, CAST(json_object('reference', any_value(reference), 'variables', list(p_name ORDER BY p_partkey)) AS VARCHAR) AS specification FROM part JOIN ref ON p_brand = id GROUP BY 1")
def study_specification(spark, sf_dir):
    """The catalogue of a block as one JSON text, with its number."""
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))["p_name"].alias("variables"))
    return parts.join(numeric_references(spark, sf_dir), "id").select(F.col("id").alias("p_brand"), F.to_json(F.struct("reference", "variables")).alias("specification"))


# candidates
@query("g15_derived_tags", "SELECT p_partkey, concat(CASE WHEN contains(p_name, 'red') THEN 'A' END, CASE WHEN p_size > 25 THEN 'C' END, CASE WHEN p_type = 'PROMO' THEN 'D' END, CASE WHEN p_retailprice > 1000 THEN 'E' END) AS tags FROM part")
def derived_tags(spark, sf_dir):
    tags = F.array(F.when(F.col("p_size") > 25, "C"), F.when(F.col("p_type") == "PROMO", "D"), F.when(F.contains("p_name", F.lit("red")), "A"), F.when(F.col("p_retailprice") > 1000, "E"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_compact(tags)), "").alias("tags"))


_TAGS = {"A": "accepted", "N": "no_clear_difference", "R": "rejected"}


@query("g16_case_tags", "SELECT l_orderkey, string_agg(DISTINCT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'no_clear_difference' ELSE 'rejected' END, ',' ORDER BY CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'no_clear_difference' ELSE 'rejected' END) AS tags FROM lineitem GROUP BY 1")
def case_tags(spark, sf_dir):
    """The kinds of results that a case has."""
    names = F.create_map(*[F.lit(x) for kv in _TAGS.items() for x in kv])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.element_at(names, F.col("l_returnflag")))), ",").alias("tags"))


@query("g17_eligible_scenarios", "SELECT p_partkey FROM part WHERE (p_brand, p_type) IN (SELECT p_brand, p_type FROM part WHERE p_size >= 49)")
def eligible_scenarios(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    rules = part.where("p_size >= 49").select("p_brand", "p_type").distinct()
    return part.join(rules.hint("merge"), ["p_brand", "p_type"], "left_semi").select("p_partkey")


_EXEC = SQL + """, p AS (SELECT 'status' AS variable, status AS answer, segment AS grp FROM r UNION ALL SELECT 'priority', priority, segment FROM r), t AS (SELECT variable, grp, count(*) AS n FROM p WHERE answer IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2),
c AS (SELECT variable, answer, sum((grp = 'BUILDING')::INT) AS ka, sum((grp = 'MACHINERY')::INT) AS kb FROM p WHERE answer IS NOT NULL AND grp IS NOT NULL GROUP BY 1, 2),
d AS (SELECT c.*, a.n AS na, b.n AS nb, sha256('["' || c.variable || '", "' || answer || '", "segment", "difference"]') AS core FROM c JOIN t a ON a.variable = c.variable AND a.grp = 'BUILDING' JOIN t b ON b.variable = c.variable AND b.grp = 'MACHINERY'),
e AS (SELECT *, CASE WHEN ('0x' || substr(core, 16, 1))::INT % 2 = 0 THEN 'higher' ELSE 'lower' END AS expected FROM d) """


@query("g22_executed_families", _EXEC + "SELECT core, variable, answer, ka::BIGINT AS ka, na, kb::BIGINT AS kb, nb, expected, CASE WHEN na < 10 OR nb < 10 THEN 'suppressed' WHEN (ka / na::DOUBLE > kb / nb::DOUBLE) = (expected = 'higher') THEN 'as_expected' ELSE 'against' END AS outcome FROM e")
def executed_families(spark, sf_dir):
    """Every family that compares two segments, run in one aggregation; directions come from the families' hashes, not from counts."""
    r = respondents(spark, sf_dir).where("segment is not null")
    long = r.select("segment", F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("answer")) for v in ("status", "priority")]))).where("answer is not null")
    side = lambda g, c: F.count_if(F.col("segment") == g).alias(c)
    counts = long.groupBy("variable", "answer").agg(side("BUILDING", "ka"), side("MACHINERY", "kb"))
    bases = W.partitionBy("variable")  # answers of a codebook
    counts = counts.withColumns({"na": F.sum("ka").over(bases), "nb": F.sum("kb").over(bases)})
    chosen = family_inventory(spark, sf_dir).where("kind = 'difference' and grouping_variable = 'segment'")
    found = chosen.join(counts.hint("merge"), ["variable", "answer"]).withColumn("expected", families.fixed_direction(F.col("core")))
    up = F.col("ka") / F.col("na") > F.col("kb") / F.col("nb")
    outcome = F.when((F.col("na") < 10) | (F.col("nb") < 10), "suppressed").when(up == (F.col("expected") == "higher"), "as_expected").otherwise("against")
    return found.select("core", "variable", "answer", "ka", "na", "kb", "nb", "expected", outcome.alias("outcome"))


@query("g24_two_draws", "WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('1:' || o_orderkey)) AS rn FROM orders) WHERE rn <= 20), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('2:' || o_orderkey)) AS rn FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM a)) WHERE rn <= 20) SELECT 'calibration' AS draw, o_orderpriority, o_orderkey FROM a UNION ALL SELECT 'evaluation', o_orderpriority, o_orderkey FROM b")
def two_draws(spark, sf_dir):
    """Two draws by stratum; the second one keeps away from the customers of the first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    first = families.take_by_hash(o, "o_orderpriority", "o_orderkey", 1, F.lit(20))
    rest = o.join(first.select("o_custkey").distinct().hint("merge"), "o_custkey", "left_anti")
    second = families.take_by_hash(rest, "o_orderpriority", "o_orderkey", 2, F.lit(20))
    both = first.withColumn("draw", F.lit("calibration")).unionByName(second.withColumn("draw", F.lit("evaluation")))
    return both.select("draw", "o_orderpriority", "o_orderkey")


# cases
@query("g25_cases", f"WITH f AS ({OWN}) SELECT o_orderkey, CASE WHEN ('0x' || substr(h, 64, 1))::INT % 2 = 0 THEN 'Parts: ' ELSE 'It lists ' END || string_agg('part ' || l_partkey || ' times ' || l_quantity::BIGINT, ', ' ORDER BY l_linenumber, l_partkey, l_quantity) AS text FROM f JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, h")
def cases(spark, sf_dir):
    """The components of a case as a sentence, in one of two styles that its hash picks."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("x"))
    each = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    say = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("part "), x["l_partkey"], F.lit(" times "), x["l_quantity"].cast("long"))), ", ")
    h = families.digest(F.lit("orders"), F.col("l_orderkey"))
    style = F.when(F.conv(F.substring(h, 64, 1), 16, 10).cast("int") % 2 == 0, "Parts: ").otherwise("It lists ")
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return each.join(known.hint("merge"), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(style, say).alias("text"))


@query("g27_perspectives", "SELECT priority, string_agg(status || ' ' || n, ', ' ORDER BY n DESC, status) AS narrative FROM (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def perspectives(spark, sf_dir):
    """The statuses of each priority, most frequent first."""
    each = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    told = each.groupBy("priority").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "status", "n"))).alias("xs"))
    return told.select("priority", F.array_join(F.transform("xs", lambda x: F.concat(x["status"], F.lit(" "), x["n"])), ", ").alias("narrative"))


@query("g28_contracts", "SELECT l_orderkey, CAST(to_json(list({'line': l_linenumber, 'brand': p_brand, 'relation': CASE WHEN l_quantity > 25 THEN 'above' ELSE 'below' END} ORDER BY l_linenumber, p_brand, l_quantity > 25 DESC)) AS VARCHAR) AS contract FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def contracts(spark, sf_dir):
    """The analyses that a claim requires, as JSON: components with what they are bound to."""
    bound = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") > 25, "above").otherwise("below").alias("relation"))
    return lines.join(bound.hint("merge"), "l_partkey").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", "brand", "relation")))).alias("contract"))


@query("g29_blueprints", "WITH g AS (SELECT DISTINCT pattern, p_brand, p_type, sha256('[\"' || pattern || '\", \"' || p_brand || '\", \"' || p_type || '\"]') AS family FROM part, (VALUES ('share'),('rank'),('trend')) x(pattern)) SELECT pattern, family, CASE WHEN ('0x' || substr(family, 16, 1))::INT % 2 = 0 THEN 'higher' ELSE 'lower' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY sha256('9:' || family)) AS rn FROM g) WHERE rn <= 8")
def blueprints(spark, sf_dir):
    """Eight families for each pattern in hash order: patterns times the distinct cards of a catalogue."""
    cards = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    grid = cards.withColumn("pattern", F.explode(F.array(*map(F.lit, ("share", "rank", "trend"))))).withColumn("family", families.digest(F.col("pattern"), F.col("p_brand"), F.col("p_type")))
    return families.take_by_hash(grid, "pattern", "family", 9, F.lit(8)).select("pattern", "family", families.fixed_direction(F.col("family")).alias("direction"))


@query("g31_lineage", REC + "SELECT record_id, family, split, CASE WHEN length(input) < 200 THEN 'low' ELSE 'high' END AS difficulty, length(output) - length(replace(output, ' ', '')) + 1 AS words FROM sp")
def lineage(spark, sf_dir):
    words = F.length("output") - F.length(F.replace("output", F.lit(" "), F.lit(""))) + 1
    return records(spark, sf_dir).select("record_id", "family", "split", F.when(F.length("input") < 200, "low").otherwise("high").alias("difficulty"), words.cast("long").alias("words"))


@query("g32_localised", "SELECT p_partkey, replace(replace(p_name, 'ring', 'loop'), 'bolt', 'screw') AS name, replace(p_type, 'PROMO', 'OFFER') AS kind, contains(replace(replace(p_name, 'ring', 'loop'), 'bolt', 'screw'), 'gear') AS forbidden FROM part")
def localised(spark, sf_dir):
    """Wording replaced in every string of a nested record, and whether a forbidden fragment is left."""
    nested = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_type").alias("kind")).alias("card")))
    for old, new in (("ring", "loop"), ("bolt", "screw"), ("PROMO", "OFFER")):
        nested = F.replace(nested, F.lit(old), F.lit(new))
    back = table(spark, sf_dir, "part").select("p_partkey", F.from_json(nested, "name string, card struct<kind:string>").alias("x"), F.contains(nested, F.lit("gear")).alias("forbidden"))
    return back.select("p_partkey", "x.name", "x.card.kind", "forbidden")


@query("g34_stressors", "SELECT doc_id, concat_ws(',', CASE WHEN length(t) > 4000 THEN 'long' END, CASE WHEN length(t) < 100 THEN 'short' END, CASE WHEN regexp_matches(t, '[0-9]{3}') THEN 'numbers' END, CASE WHEN contains(t, chr(10) || chr(10)) THEN 'sections' END) AS stressors FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def stressors(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    tags = F.concat_ws(",", F.when(F.length(t) > 4000, "long"), F.when(F.length(t) < 100, "short"), F.when(t.rlike("[0-9]{3}"), "numbers"), F.when(F.contains(t, F.lit("\n\n")), "sections"))
    return table(spark, sf_dir, "documents").select("doc_id", tags.alias("stressors"))


@query("g40_meaning_checklist", SQL + ", c AS (SELECT DISTINCT 'status' AS variable, status AS answer FROM r UNION SELECT DISTINCT 'priority', priority FROM r), g AS (SELECT variable, answer, b, k, sha256('[\"' || variable || '\", \"' || answer || '\", \"' || b || '\", \"' || k || '\"]') AS core FROM c, (VALUES ('segment'),('region'),('status')) g(b), (VALUES ('difference'),('threshold')) t(k) WHERE variable <> b) SELECT core, unnest([1, 2, 3]) AS item, unnest(['asks about ' || variable, 'counts ' || answer, k || ' across ' || b]) AS statement FROM g")
def meaning_checklist(spark, sf_dir):
    """What a paraphrase of each family must keep, item by item."""
    parts = F.array(F.concat(F.lit("asks about "), "variable"), F.concat(F.lit("counts "), "answer"), F.concat_ws(" across ", "kind", "grouping_variable"))
    return family_inventory(spark, sf_dir).select("core", F.posexplode(parts).alias("i", "statement")).select("core", (F.col("i") + 1).alias("item"), "statement")


@query("g42_rubric_rows", "SELECT l_orderkey, item, string_agg(l_partkey, ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'states' ELSE 'leaves out' END AS item FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY 1, 2")
def rubric_rows(spark, sf_dir):
    """Template rows with the results they are about; a template without results is left out."""
    results = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct("l_returnflag", "l_partkey")).alias("rs"))
    pick = lambda flag: F.array_sort(F.transform(F.filter("rs", lambda r: r["l_returnflag"] == flag), lambda r: r["l_partkey"]))
    templates = F.array(F.struct(F.lit("states").alias("item"), pick("A").alias("ps")), F.struct(F.lit("leaves out").alias("item"), pick("R").alias("ps")))
    return results.select("l_orderkey", F.inline(templates)).where(F.size("ps") > 0).select("l_orderkey", "item", F.array_join(F.col("ps").cast("array<string>"), ",").alias("parts"))


# publishing
@query("io13_slices", REC + ", s AS (SELECT *, CASE WHEN split = 'test' AND conv_id IN (SELECT conv_id FROM sp WHERE split = 'train') THEN 'test_familiar' ELSE split END AS slice FROM (SELECT r.*, CASE WHEN v < 0.7 THEN 'train' ELSE 'test' END AS split FROM (SELECT conv_id, record_id, input, ('0x' || substr(sha256('[\"record\", \"' || record_id || '\"]'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS v FROM rec) r)) SELECT slice, count(*) AS n, count(DISTINCT conv_id) AS studies FROM s GROUP BY 1")
def slices(spark, sf_dir):
    """Records with their study, written by slice and read again; test records of a study owned by training form a slice of their own."""
    by_record = families.owner(families.digest(F.lit("record"), F.col("record_id")), {"train": 0.7, "test": 0.3})
    r = records(spark, sf_dir).withColumns({"owner": F.col("split"), "split": by_record})
    familiar = r.where("owner = 'train'").select("conv_id").distinct().withColumn("known", F.lit(True))
    joined = r.join(familiar.hint("merge"), "conv_id", "left").withColumn("slice", F.when((F.col("split") == "test") & F.col("known"), "test_familiar").otherwise(F.col("split")))
    at = files.shared_folder(spark, "slices")
    files.write_jsonl(joined.select("record_id", "conv_id", "input", "slice"), at, ["slice"])
    return files.read_jsonl(spark, at, "record_id string, conv_id long, input string, slice string").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("studies"))


@query("io14_publish", REC + "SELECT split, count(*) AS n, true AS published, false AS again FROM sp GROUP BY 1")
def publish(spark, sf_dir):
    """Published when the audit finds nothing; a second try doesn't overwrite."""
    r, at = records(spark, sf_dir), files.shared_folder(spark, "published")
    faults = audits.repeated(r, "record_id")
    first, again = files.publish(r, at, faults), files.publish(r, at, faults)
    return spark.read.parquet(at).groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumns({"published": F.lit(first), "again": F.lit(again)})
