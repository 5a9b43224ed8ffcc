"""Queries of cases: candidates in stages, blueprints, contracts, seals, the verifier's gate and the audit of words."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.operators import answers, audits, cases, claims, families, gates
from tallywright.sources.files import written

from .estimation import rounded
from .meaning import _CLAIM, PLANTED, planted
from .packages import OWN, owners
from .registry import query, table
from .study import respondents

#: Labelled documents of one task.
PART = 4096
_ANALYSES = "a AS (SELECT 'p' || p_partkey AS core, p_type AS card, p_brand AS block, p_brand AS grouping, (p_size % 2)::VARCHAR AS groups, CASE WHEN p_size % 3 = 0 THEN 'support' WHEN p_size % 3 = 1 THEN 'contradict' ELSE 'inconclusive' END AS label, p_size % 4 = 0 AS threshold, p_size > 5 AS tested, p_size % 7 <> 0 AS stable FROM part)"
_D = lambda *parts: "sha256('[\"' || " + " || '\", \"' || ".join(parts) + " || '\"]')"


@query(
    "g14_candidate_stages",
    f"""WITH {_ANALYSES}, blocked AS (SELECT 'p' || p_partkey AS key FROM part WHERE p_partkey % 11 = 0 UNION SELECT {_D("'missing'", "'historical'", "'p' || p_partkey")} FROM part WHERE p_partkey % 5 = 0),
    rules AS (SELECT 'causal' AS scenario, 'p' || p_partkey AS core FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'historical', 'p' || p_partkey FROM part WHERE p_partkey % 2 = 0),
    free AS (SELECT * FROM a WHERE stable AND core NOT IN (SELECT key FROM blocked)), plain AS (SELECT * FROM free WHERE tested AND NOT threshold),
    few AS (SELECT *, {_D("block", "grouping", "groups")} AS bucket FROM plain QUALIFY row_number() OVER (PARTITION BY block, grouping, groups ORDER BY sha256('5:' || core)) <= 24),
    pairs AS (SELECT x.core AS ca, y.core AS cb, x.label AS la, y.label AS lb FROM few x JOIN few y USING (bucket) WHERE x.core < y.core AND x.card <> y.card QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY sha256('5:' || x.core || '+' || y.core)) <= 60),
    missing AS (SELECT core, {_D("'missing'", "'historical'", "core")} AS key FROM free JOIN rules USING (core) WHERE tested AND threshold AND scenario = 'historical')
    SELECT 'single' AS stage, CASE WHEN tested THEN 'single' ELSE 'suppression' END AS scenario, {_D("core")} AS family, core AS cores, 'available' AS availability, label AS labels FROM free
    UNION ALL SELECT 'scenario', 'causal', {_D("core")}, core, 'partially_available', array_to_string(list_sort([label, 'not_applicable']), ',') FROM plain JOIN rules USING (core) WHERE scenario = 'causal'
    UNION ALL SELECT 'pair', 'compound', {_D("ca", "cb")}, ca || ',' || cb, 'available', array_to_string(list_sort(list_distinct([la, lb])), ',') FROM pairs
    UNION ALL SELECT 'context', 'historical', key, '', 'unavailable', 'unavailable' FROM missing WHERE key NOT IN (SELECT key FROM blocked)""",
)
def candidate_stages(spark, sf_dir):
    """Parts as analyses: singles, scenarios, pairs and missing evidence, clear of blocked ones, with caps that hold after the exclusion."""
    p = table(spark, sf_dir, "part")
    core, size = F.concat(F.lit("p"), "p_partkey"), F.col("p_size")
    label = F.when(size % 3 == 0, "support").when(size % 3 == 1, "contradict").otherwise("inconclusive")
    analyses = p.select(core.alias("core"), F.col("p_type").alias("card"), F.col("p_brand").alias("block"), F.col("p_brand").alias("grouping"), (size % 2).cast("string").alias("groups"), label.alias("label"), (size % 4 == 0).alias("threshold"), (size > 5).alias("tested"), (size % 7 != 0).alias("stable"))
    blocked = p.where("p_partkey % 11 = 0").select(core.alias("key")).unionByName(p.where("p_partkey % 5 = 0").select(families.digest(F.lit("missing"), F.lit("historical"), core).alias("key")))
    rules = p.where("p_partkey % 3 = 0").select(F.lit("causal").alias("scenario"), core.alias("core")).unionByName(p.where("p_partkey % 2 = 0").select(F.lit("historical").alias("scenario"), core.alias("core")))
    return cases.candidate_stages(analyses, blocked, rules, 5).select("stage", "scenario", "family", F.array_join("cores", ",").alias("cores"), "availability", "labels")


def catalogue(spark, sf_dir):
    """Cards of each region's study, from what its respondents answered: three measures, a block of checkboxes, two demographic ones."""
    r = respondents(spark, sf_dir).where("region is not null")
    kinds = {"segment": ("demographics", "demographics", "single"), "status": ("orders", "service attributes", "single"), "priority": ("urgency", "service attributes", "ordered_scale"), "balance": ("money", "purchase intent", "single"), "nothing": ("demographics", "demographics", "single")}
    each = F.array(*[F.struct(F.lit(v).alias("id"), F.col(v).alias("x")) for v in kinds if v != "nothing"])
    seen = r.select(F.col("region").alias("study"), F.inline(each)).where("x is not null").groupBy("study", "id").agg(F.array_sort(F.collect_set("x")).alias("vals"))  # the answers of an item
    boxes = r.groupBy(F.col("region").alias("study")).agg(F.count(F.lit(1)).alias("n")).select("study", F.explode(F.array(*map(F.lit, ("ret_a", "ret_n", "ret_r")))).alias("id"), F.array(F.lit("true")).alias("vals"))
    places = [*kinds, "ret_a", "ret_n", "ret_r"]
    of = lambda i, rest: F.element_at(F.create_map(*[F.lit(x) for v in places for x in (v, kinds.get(v, rest)[i])]), F.col("id"))
    box = ("returns", "use", "select_all")
    return seen.unionByName(boxes).select("study", F.array_position(F.array(*map(F.lit, places)), F.col("id")).cast("int").alias("ordinal"), "id", of(0, box).alias("block"), of(1, box).alias("section"), of(2, box).alias("answer_type"), F.concat(F.lit("the "), "id").alias("label"), "vals")


@query("g29_study_blueprints")
def study_blueprints(spark, sf_dir):
    """Forty blueprints for each region's study, over sixteen patterns; contrasts are neighbouring segments."""
    cards = catalogue(spark, sf_dir)
    segments = cards.where("id = 'segment'").select("study", "vals")
    pairs = segments.select("study", F.posexplode(F.transform(F.slice("vals", 1, F.greatest(F.size("vals") - 1, F.lit(1))), lambda x, i: F.array(x, F.get(F.col("vals"), i + 1)))).alias("place", "groups")).where("groups[1] is not null")
    found = cases.blueprints(cards, pairs.withColumn("grouping", F.lit("segment")), 40, 9)
    return found.select("study", "place", "pattern", "family", F.size("analyses").alias("n_analyses"), F.array_join(F.transform("analyses", lambda a: a["expect"]), "").alias("expects"), F.array_join("gaps", ",").alias("gaps"), "proxy", "claim")


#: The fields of both contracts that the counts need; a parser skips the others.
_ANALYSIS_READ = "components array<struct<id:string>>, required array<struct<component:string>>, gaps array<struct<component:string>>"
_SYNTHESIS_READ = "relation_depth int, findings array<struct<contrast:struct<estimate:string>,estimates:array<struct<grp:string>>,limitation:string>>"


@query(
    "g28_case_contracts",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey AS case_id, max(n) AS components, count(*) FILTER (l_returnflag <> 'N') AS required, count(*) FILTER (l_returnflag = 'N') AS gaps, greatest(max(n) - 1, 0) AS relation_depth,
           count(*) FILTER (l_returnflag <> 'N') AS contrasts, count(*) FILTER (l_returnflag <> 'N') AS estimates, count(*) FILTER (l_returnflag = 'N') AS limited FROM l GROUP BY 1""",
)
def case_contracts(spark, sf_dir):
    """Both contracts of each order as a case, read back from JSON: lines are components, open ones have a limitation; each relation is of the one before and the next line, so they nest."""
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")  # the lines of an order
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.row_number().over(by).alias("i"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("q"))
    cid, bound = F.concat(F.lit("c"), "i"), F.col("flag") != "N"
    components = lines.select("case_id", cid.alias("id"), F.concat(F.lit("line "), "i").alias("text"), F.lit("share").alias("estimand"), F.lit("orders").alias("scope"), F.when(~bound, "It is open.").alias("limitation"))
    bindings = lines.where(bound).select("case_id", cid.alias("component"), F.lit("quantity").alias("variable"), F.lit("selection").alias("operation"), F.array(F.lit("high")).alias("groups"), F.lit(0.5).alias("threshold"), F.lit(">").alias("expect"))
    relations = lines.where("i >= 2").select("case_id", F.col("i").alias("place"), F.concat(F.lit("r"), "i").alias("id"), F.lit("and").alias("kind"), F.array(F.when(F.col("i") == 2, "c1").otherwise(F.concat(F.lit("r"), F.col("i") - 1)), cid).alias("members"))
    contrasts = lines.where(bound).select("case_id", cid.alias("component"), F.concat(F.lit("e"), "i").alias("estimate"), F.col("q").alias("value"), F.lit("consistent").alias("label"))
    estimates = lines.where(bound).select("case_id", F.concat(F.lit("e"), "i").alias("estimate"), F.explode(F.array(F.lit("high"), F.lit("low"))).alias("grp"), F.lit(10).cast("long").alias("n"), F.col("q").alias("value"))
    made = cases.contracts(components, bindings, relations, contrasts, estimates)
    back = made.select("case_id", F.from_json("analysis", _ANALYSIS_READ).alias("a"), F.from_json("synthesis", _SYNTHESIS_READ).alias("s"))
    found = "s.findings"
    # of the two estimates of a contrast only that of the group asked for is shown
    return back.select("case_id", F.size("a.components").cast("long").alias("components"), F.size("a.required").cast("long").alias("required"), F.size("a.gaps").cast("long").alias("gaps"), F.col("s.relation_depth").cast("long").alias("relation_depth"), F.size(F.filter(found, lambda f: f["contrast"].isNotNull())).cast("long").alias("contrasts"), F.aggregate(found, F.lit(0), lambda n, f: n + F.coalesce(F.size(f["estimates"]), F.lit(0))).cast("long").alias("estimates"), F.size(F.filter(found, lambda f: f["limitation"].isNotNull())).cast("long").alias("limited"))


_KINDS = ["flip_direction", "swap_groups", "change_threshold", "drop_part", "add_causal", "drop_population", "swap_measure", "never_planted"]
_GATE = {"acceptance": 0.9, "self_agreement": 0.95, "rejection": 0.8}
_ITEMS = {"length": "length(changed) >= length(claim)", "cause": "NOT contains(changed, 'because')", "capitals": "{sort}(regexp_extract_all(changed, '[A-Z]+'{all})) = {sort}(regexp_extract_all(claim, '[A-Z]+'{all}))"}


@query(
    "k30_gate_summary",
    PLANTED
    + f""", j AS (SELECT c_custkey, kind, 1 AS run, changed, claim FROM p WHERE changed IS NOT NULL UNION ALL SELECT c_custkey, 'original', run, claim, claim FROM c, (VALUES (1), (2)) t(run)),
    v AS (SELECT *, kind = 'original' AND run = 2 AND c_custkey % 40 = 0 AS failed, unnest(['length', 'cause', 'capitals']) AS item, unnest([{_ITEMS['length']} AND NOT (kind = 'original' AND run = 2 AND c_custkey % 25 = 1), {_ITEMS['cause']}, {_ITEMS['capitals'].format(sort='list_sort', all='')}]) AS passed FROM j),
    e AS (SELECT c_custkey, kind, run, bool_or(failed) AS failed, bool_and(passed) AND NOT bool_or(failed) AS accepted FROM v GROUP BY 1, 2, 3),
    twice AS (SELECT c_custkey, item, max(passed::INT) FILTER (run = 1) AS a, max(passed::INT) FILTER (run = 2) AS b FROM v WHERE kind = 'original' AND NOT failed GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL),
    r AS (SELECT 'calls' AS measure, count(*) AS n, count(*) FILTER (NOT failed) AS hits, 1.0 AS need FROM e UNION ALL SELECT 'acceptance', count(*) FILTER (kind = 'original' AND run = 1), count(*) FILTER (kind = 'original' AND run = 1 AND accepted), 0.9 FROM e
          UNION ALL SELECT 'rejection:' || k, count(kind), count(kind) FILTER (NOT accepted), 0.8 FROM (SELECT unnest({_KINDS}) AS k) q LEFT JOIN e ON e.kind = q.k GROUP BY k UNION ALL SELECT 'self_agreement', count(*), count(*) FILTER (a = b), 0.95 FROM twice),
    m AS (SELECT measure, n, hits, round(hits / nullif(n, 0), 8) AS rate, need::DOUBLE AS need, CASE WHEN measure LIKE 'rejection:%' AND n = 0 THEN NULL ELSE coalesce(hits / nullif(n, 0) >= need, false) END AS met FROM r)
    SELECT * FROM m UNION ALL SELECT 'gate', count(met), count(*) FILTER (met), round(count(*) FILTER (met) / count(met), 8), 1.0, count(met) = count(*) FILTER (met) FROM m""",
)
def gate_summary(spark, sf_dir):
    """The gate of a verifier that looks at length, causes and capitals, on claims of customers and seven planted changes; second runs of originals fail or flip at times."""
    original = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CLAIM).alias("claim")).select("c_custkey", F.lit("original").alias("kind"), F.col("claim").alias("changed"), "claim", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"))
    jobs = planted(spark, sf_dir).select("c_custkey", "kind", "changed", "claim", F.lit(1).alias("run")).unionByName(original).withColumn("id", F.concat_ws(":", "c_custkey", "kind", "run"))
    jobs = written(jobs, "jobs")
    again = (F.col("kind") == "original") & (F.col("run") == 2)
    calls = jobs.select("id", F.when(again & (F.col("c_custkey") % 40 == 0), "Timeout").alias("error"))
    capitals = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("[A-Z]+"), F.lit(0)))
    items = {"length": (F.length("changed") >= F.length("claim")) & ~(again & (F.col("c_custkey") % 25 == 1)), "cause": ~F.contains("changed", F.lit("because")), "capitals": capitals("changed") == capitals("claim")}
    verdicts = jobs.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("item"), x.alias("passed")) for k, x in items.items()])))
    return rounded(gates.verifier_gate(jobs.select("id", F.col("c_custkey").alias("record_id"), "kind", "run"), calls, verdicts, _GATE, _KINDS))


@query(
    "g41_grouped_audit",
    """WITH d AS (SELECT doc_id, source AS grp, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label, coalesce(text, '') AS text, source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) WHERE i <= ceil(n / 2)) AS test FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND source IS NOT NULL),
    w AS (SELECT doc_id, label, test, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM d), l AS (SELECT label, w, count(*) AS k FROM w WHERE NOT test GROUP BY 1, 2), t AS (SELECT label, sum(k) AS total FROM l GROUP BY 1), v AS (SELECT count(DISTINCT w) AS v FROM l), n AS (SELECT label, count(*) AS docs FROM d WHERE NOT test GROUP BY 1), tn AS (SELECT sum(docs) AS train FROM n),
    known AS (SELECT DISTINCT w FROM l), tw AS (SELECT doc_id, w, count(*) AS k FROM w JOIN known USING (w) WHERE test GROUP BY 1, 2),
    s AS (SELECT doc_id, n.label, sum(tw.k * ln((coalesce(l.k, 0) + 1) / (t.total + v.v)::DOUBLE)) AS s FROM tw CROSS JOIN n JOIN t ON t.label = n.label CROSS JOIN v LEFT JOIN l ON l.w = tw.w AND l.label = n.label GROUP BY 1, 2),
    j AS (SELECT d.doc_id, d.label, arg_min(n.label, (-(ln(n.docs / train::DOUBLE) + coalesce(s.s, 0)), n.label)) AS said FROM d CROSS JOIN n CROSS JOIN tn LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = n.label WHERE test GROUP BY 1, 2),
    f AS (SELECT avg((said = label)::INT) AS accuracy, avg((label = (SELECT arg_min(label, (-docs, label)) FROM n))::INT) AS baseline, count(*) AS test FROM j)
    SELECT 'completed' AS status, train::BIGINT AS train, test, round(accuracy, 8) AS accuracy, round(baseline, 8) AS baseline, accuracy > baseline + 0.1 AS flagged FROM f, tn""",
)
def grouped_audit(spark, sf_dir):
    """How well words tell good, poor and toxic documents of the sources that weren't learnt from, the first half by name."""
    docs = table(spark, sf_dir, "documents")
    sources = sorted(r[0] for r in docs.where("source is not null").select("source").distinct().collect())  # names of sources, a setting of the corpus
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    labels = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), labels.count() // PART + 1)  # a task has so many documents, however many there are
    rows = docs.repartition(parts, "doc_id").join(labels.repartition(parts, "doc_id").hint("merge"), "doc_id").select(F.col("doc_id").alias("id"), "text", label.alias("label"), F.col("source").alias("grp"))
    return rounded(audits.lexical(rows, sources[: -(-len(sources) // 2)]))


@query(
    "l08_sealed_estimates",
    "SELECT c_nationkey AS nation, CASE c_nationkey % 5 WHEN 0 THEN 'changed' WHEN 1 THEN 'forged' WHEN 2 THEN 'foreign' ELSE '' END AS verdict FROM customer GROUP BY 1",
)
def sealed_estimates(spark, sf_dir):
    """Estimates of nations handed back: a fifth with another value, a fifth sealed anew with another value, a fifth of another session."""
    made = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"))
    own = cases.sealed(made, "s1", "pack", "nation", ["n", "k"])
    kind = F.col("nation") % 5
    more = F.col("k") + 1
    changed = own.where(kind == 0).withColumn("k", more)
    forged = cases.sealed(made.where(kind == 1).withColumn("k", more), "s1", "pack", "nation", ["n", "k"])
    foreign = cases.sealed(made.where(kind == 2), "s2", "pack", "nation", ["n", "k"])
    handed = own.where(kind > 2).unionByName(changed).unionByName(forged).unionByName(foreign)
    return cases.unsealed(handed, own, "s1", "pack", "nation", ["n", "k"]).select("nation", "verdict")


@query(
    "j12_changed_plan",
    f"WITH f AS ({OWN}), o AS (SELECT o_orderkey AS k, CASE WHEN ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.8 THEN 'train' WHEN ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.9 THEN 'validation' ELSE 'test' END AS owner FROM f) SELECT CASE WHEN k % 97 = 0 THEN 'missing' WHEN k % 53 = 0 THEN 'repeated' ELSE 'other_owner' END AS fault, k::VARCHAR AS key FROM o WHERE k % 97 = 0 OR k % 53 = 0 OR (k % 89 = 0 AND owner <> 'test') UNION ALL SELECT 'unknown', 'x' || k FROM o WHERE k % 211 = 0 AND k % 97 <> 0 UNION ALL SELECT 'other_size', unnest(['train', 'validation', 'test'])",
)
def changed_plan(spark, sf_dir):
    """A frozen plan of the orders in which some owners were changed, and some keys left out, repeated or made up, with sizes of nought."""
    now = owners(spark, sf_dir).select(F.col("o_orderkey").alias("key"), "owner")
    key = F.col("key")
    kept = now.where(key % 97 != 0)
    frozen = kept.withColumn("owner", F.when((key % 89 == 0) & (key % 53 != 0), "test").otherwise(F.col("owner"))).withColumn("key", key.cast("string"))
    frozen = frozen.unionByName(kept.where(key % 53 == 0).withColumn("key", key.cast("string"))).unionByName(kept.where(key % 211 == 0).withColumn("key", F.concat(F.lit("x"), key)))
    sizes = spark.createDataFrame([("train", 0), ("validation", 0), ("test", 0)], "owner string, size long")
    return audits.plan_faults(frozen, now, sizes)


@query(
    "j18_reference_faults",
    "WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer GROUP BY 1, 2) SELECT nation, segment, CASE WHEN segment = 'FURNITURE' AND nation % 4 = 1 THEN 'only_reference' WHEN segment = 'BUILDING' AND nation % 4 = 0 THEN 'k' WHEN segment = 'BUILDING' AND nation % 4 = 2 THEN 'share' WHEN segment = 'MACHINERY' AND nation % 4 = 3 THEN 'direction' END AS fault FROM c WHERE fault IS NOT NULL",
)
def reference_faults(spark, sf_dir):
    """Counts, shares and directions of each nation and segment against an independent calculation; some of the first were changed or left out."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).alias("owes"))
    way = F.when(F.col("share") > 0.1, "higher").otherwise("lower")
    reference = c.groupBy("nation", "segment").agg(F.sum(F.col("owes").cast("long")).alias("k"), F.avg(F.col("owes").cast("double")).alias("share")).withColumn("direction", way)
    made = c.groupBy("nation", "segment").agg(F.count_if("owes").alias("k"), (F.count_if("owes") / F.count(F.lit(1))).alias("share")).withColumn("direction", way)
    at = lambda s, r: (F.col("segment") == s) & (F.col("nation") % 4 == r)
    changed = made.where(~at("FURNITURE", 1)).withColumns({"k": F.when(at("BUILDING", 0), F.col("k") + 1).otherwise(F.col("k")), "share": F.when(at("BUILDING", 2), F.col("share") + 1e-9).otherwise(F.col("share")), "direction": F.when(at("MACHINERY", 3), "none").otherwise(F.col("direction"))})
    return audits.reference_faults(changed, reference, ["nation", "segment"], ["k", "share"], ["direction"])


@query("k08_answer_tokens")
def answer_tokens(spark, sf_dir):
    """Numbers of every text by the rule of written answers: how many, with a unit, with a comparator, and the least and greatest of them."""
    found = answers.tokens(F.coalesce("text", F.lit("")))
    t = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.array(found), lambda x: x)[0].alias("t"))
    numbers = F.transform("t", lambda x: x["number"].cast("double"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.filter("t", lambda x: x["unit"] != "")).cast("long").alias("n_unit"), F.size(F.filter("t", lambda x: x["cmp"] != "")).cast("long").alias("n_cmp"), F.array_min(numbers).alias("lo"), F.array_max(numbers).alias("hi"))


@query(
    "g40_claim_checks",
    """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, c_nationkey AS n FROM customer), p AS (SELECT k, 1 AS place, 'difference' AS kind, s, n FROM c UNION ALL SELECT k, 2, 'threshold', s, n FROM c WHERE k % 2 = 0)
    SELECT k AS claim_id, 'P' || place || '_measure' AS item, 'The part measures: owing.' AS statement, true AS quote_required FROM p
    UNION ALL SELECT k, 'P' || place || '_groups', CASE kind WHEN 'threshold' THEN 'It is about ' || s || '.' ELSE 'It compares ' || s || ' with OTHER.' END, true FROM p
    UNION ALL SELECT k, 'P' || place || '_direction', CASE kind WHEN 'threshold' THEN 'It says more than half of them.' ELSE 'It says that ' || s || ' do it more often than OTHER.' END, true FROM p
    UNION ALL SELECT k, 'P' || place || '_population', 'It is only about nation ' || n || '.', true FROM p WHERE k % 3 = 0
    UNION ALL SELECT k, 'G1', 'What is said of causal effect stays as it is said.', true FROM c WHERE k % 4 = 0 UNION ALL SELECT k, 'X1', 'q1, q2 stand for buying.', true FROM c WHERE k % 6 = 0
    UNION ALL SELECT k, 'W_causal', CASE WHEN k % 5 = 0 THEN 'The cause is kept as it is said.' ELSE 'No cause is named.' END, k % 5 = 0 FROM c UNION ALL SELECT k, 'W_extra', 'Nothing is added.', false FROM c""",
)
def claim_checks(spark, sf_dir):
    """What paraphrases of the customers' claims must keep, from their parts, gaps and proxies."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim_id"), F.col("c_mktsegment").alias("a"), F.concat(F.lit("nation "), "c_nationkey").alias("population"))
    k = F.col("claim_id")
    part = lambda df, place, kind, direction: df.select("claim_id", F.lit(place).alias("place"), F.lit("owing").alias("measure"), F.lit(kind).alias("kind"), "a", F.lit("OTHER").alias("b"), F.lit(direction).alias("direction"), F.when(k % 3 == 0, F.col("population")).alias("population"))
    parts = part(c, 1, "difference", "more often than").unionByName(part(c.where(k % 2 == 0), 2, "threshold", "more than"))
    gaps = c.where(k % 4 == 0).select("claim_id", F.lit(1).alias("place"), F.lit("causal effect").alias("concept"))
    proxies = c.where(k % 6 == 0).select("claim_id", F.lit(1).alias("place"), F.lit("buying").alias("concept"), F.array(F.lit("q1"), F.lit("q2")).alias("variables"))
    return claims.meaning_checks(c.select("claim_id", (k % 5 == 0).alias("causal")), parts, gaps, proxies)


@query(
    "g42_numerical_rows",
    """WITH e AS (SELECT c_nationkey AS n, c_mktsegment AS s FROM customer GROUP BY 1, 2), k AS (SELECT * FROM e WHERE n % 2 = 1 OR (n % 6 <> 0 AND s IN ('BUILDING', 'MACHINERY')))
    SELECT n AS case_id, 'e1' AS id, 'estimate' AS kind, string_agg(s, ',' ORDER BY s) AS groups FROM k WHERE n % 5 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT n, 'c1', 'contrast', NULL FROM e WHERE n % 5 <> 0 AND n % 3 <> 0""",
)
def numerical_rows(spark, sf_dir):
    """The results of each nation whose numbers are asked for: even nations ask for two segments, some for one that there isn't, every fifth for none."""
    e = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("case_id"), F.col("c_mktsegment").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("value")).withColumn("id", F.lit("e1"))
    n = F.col("case_id")
    case = e.select("case_id").distinct()
    of = lambda df, i, kind: df.select("case_id", F.lit(i).alias("id"), F.lit(kind).alias("kind"), F.lit("owing").alias("variable"), F.lit("share").alias("operation"))
    results = of(case, "e1", "estimate").unionByName(of(case.where(n % 3 != 0), "c1", "contrast")).unionByName(of(case, "g1", "gap"))
    asked = F.when(n % 6 == 0, F.array(F.lit("NOBODY"))).otherwise(F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
    wanted = case.where(n % 2 == 0).select("case_id", F.explode(asked).alias("grp"))
    found = claims.numerical_requirements(results, e, wanted, case.select("case_id", (n % 5 != 0).alias("asked")))
    return found.select("case_id", "id", "kind", F.array_join("groups", ",").alias("groups"))
