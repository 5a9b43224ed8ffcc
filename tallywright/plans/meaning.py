"""Queries of claims' meaning: planted changes, what answers are checked for, and the search of a catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import claims

from .estimation import rounded
from .inference import _ADJUSTED, _PACK_SQL, evidence, sql_holm_label
from .registry import query, table

_LABELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
#: A claim of each customer: which sentences it has depends on its number.
_CLAIM = "concat(c_mktsegment, ' customers owe more often than OTHER customers.', CASE WHEN c_custkey % 2 = 0 THEN concat(' More than half name ''', c_mktsegment, '''.') ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN concat(' This is only among people of nation ', c_nationkey, '.') ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN ' It is caused by age.' ELSE '' END)"
_SW = lambda t, a, b: f"replace(replace(replace({t}, {a}, chr(1)), {b}, {a}), chr(1), {b})"
_FLIP = _SW(_SW(_SW("claim", "'more often'", "'less often'"), "'More than half'", "'Fewer than half'"), "'more than half'", "'fewer than half'")
PLANTED = f"""WITH c AS (SELECT c_custkey, c_mktsegment AS a, {_CLAIM} AS claim, c_custkey % 2 = 0 AS measured, c_custkey % 3 = 0 AS peopled, c_custkey % 5 = 0 AS causal FROM customer),
s AS (SELECT *, list_filter(string_split(regexp_replace(claim, '([.?!])\\s+', '\\1\n', 'g'), '\n'), lambda x: x <> '') AS said, 1 + measured::INT AS parts, list_filter({_LABELS}, lambda x: x <> a) AS others FROM c),
p AS (SELECT c_custkey, 'flip_direction' AS kind, {_FLIP} AS changed, claim FROM s UNION ALL SELECT c_custkey, 'swap_groups', {_SW('claim', 'a', "'OTHER'")}, claim FROM s UNION ALL SELECT c_custkey, 'change_threshold', CASE WHEN measured THEN regexp_replace(claim, '\\bhalf\\b', 'a third') END, claim FROM s
UNION ALL SELECT c_custkey, 'drop_part', CASE WHEN len(said) > 1 AND parts > 1 THEN array_to_string(said[:len(said) - 1], ' ') END, claim FROM s UNION ALL SELECT c_custkey, 'add_causal', CASE WHEN NOT causal THEN claim || '{claims.CAUSE}' END, claim FROM s
UNION ALL SELECT c_custkey, 'drop_population', CASE WHEN peopled THEN replace(claim, regexp_extract(claim, ' This is only among people of nation [0-9]+\\.'), '') END, claim FROM s
UNION ALL SELECT c_custkey, 'swap_measure', CASE WHEN measured THEN replace(claim, concat('''', a, ''''), concat('''', others[c_custkey % 4 + 1], '''')) END, claim FROM s) """


def planted(spark, sf_dir):
    """(c_custkey, kind, changed, claim) of each kind of change that a customer's claim allows."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("a"), F.expr(_CLAIM).alias("claim"))
    key = F.col("c_custkey")
    kinds = claims.planted(F.col("claim"), F.col("a"), F.lit("OTHER"), F.array(*map(F.lit, _LABELS)), 1 + (key % 2 == 0).cast("int"), key % 5 == 0, key % 3 == 0, key)
    return c.select("c_custkey", "claim", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("changed")) for k, x in kinds.items()]))).where("changed is not null").select("c_custkey", "kind", "changed", "claim")


@query("g38_planted_changes", PLANTED + "SELECT c_custkey, kind, changed FROM p WHERE changed IS NOT NULL")
def planted_changes(spark, sf_dir):
    """Seven kinds of changes of meaning, each planted where the claim allows it."""
    return planted(spark, sf_dir).drop("claim")


_CAUGHT = "(length({c}) < length(claim) OR contains({c}, 'because') OR list_sort(regexp_extract_all({c}, '[A-Z]+')) <> list_sort(regexp_extract_all(claim, '[A-Z]+')))"


@query("k30_verifier_gate", PLANTED + f", t AS (SELECT kind, changed, claim FROM p WHERE changed IS NOT NULL UNION ALL SELECT 'unchanged', claim, claim FROM c) SELECT kind, count(*) AS n, count(*) FILTER {'(WHERE ' + _CAUGHT.format(c='changed') + ')'} AS rejected, round(avg({_CAUGHT.format(c='changed')}::INT), 8) AS rate FROM t GROUP BY 1")
def verifier_gate(spark, sf_dir):
    """How often a simple verifier rejects each planted change, and the unchanged claim: it looks at length, causes and capitals."""
    p = planted(spark, sf_dir)
    same = table(spark, sf_dir, "customer").select(F.expr(_CLAIM).alias("claim")).select(F.lit("unchanged").alias("kind"), F.col("claim").alias("changed"), "claim")
    tried = p.select("kind", "changed", "claim").unionByName(same)
    capitals = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("[A-Z]+"), F.lit(0)))
    no = (F.length("changed") < F.length("claim")) | F.contains("changed", F.lit("because")) | (capitals("changed") != capitals("claim"))
    return rounded(tried.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(no).alias("rejected"), F.avg(no.cast("int")).alias("rate")))


_LABELLED = f"SELECT part || '.' || a || '.' || b AS id, CASE WHEN expect IS NULL THEN 'unavailable' WHEN p >= 0.05 THEN 'no_clear_difference' WHEN expect = '!=' OR value > 0 THEN 'consistent' ELSE 'inconsistent' END AS label, {sql_holm_label('sign(value)', 'p_holm', 'expect')} AS label_holm FROM ({_ADJUSTED})"


@query("k04_checklist", _PACK_SQL + f""", l AS ({_LABELLED}), x AS (SELECT 'E1:' || id AS item, 'E1_direction' AS type, true AS critical FROM l WHERE label IN ('consistent', 'inconsistent') UNION ALL SELECT 'E9:' || id, 'E9_adjustment', false FROM l WHERE label IN ('consistent', 'inconsistent') AND label_holm <> label UNION ALL SELECT 'E2:' || id, 'E2_inconclusive', true FROM l WHERE label = 'no_clear_difference'
UNION ALL SELECT 'E11:' || id, 'E11_unavailable', true FROM l WHERE label = 'unavailable' UNION ALL SELECT 'E3:g' || r_regionkey, 'E3_gap', true FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'E4:g' || r_regionkey, 'E4_proxy', false FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT 'E7:s1.q1:' || n_name, 'E7_suppression', true FROM nation WHERE n_nationkey % 10 = 3
UNION ALL SELECT 'E5', 'E5_no_verdict', true UNION ALL SELECT 'E6', 'E6_no_causal', true UNION ALL SELECT 'E8', 'E8_scope', false UNION ALL SELECT 'E10', 'E10_balance', false WHERE EXISTS (SELECT 1 FROM l WHERE label = 'inconsistent')) SELECT *, type NOT IN ('E5_no_verdict', 'E7_suppression') AS quote_required FROM x""")
def checklist(spark, sf_dir):
    """The checklist of a pack's answer, all eleven kinds of items; regions stand for gaps, and some nations for hidden groups.

    The label is by the unadjusted p here, so that SQL needs no interval; a contrast that nothing was expected of counts as unavailable.
    """
    e = evidence(spark, sf_dir)
    sided = F.when((F.col("expect") == "!=") | (F.col("value") > 0), "consistent").otherwise("inconsistent")
    label = F.when(F.col("expect").isNull(), "unavailable").when(F.col("p") >= 0.05, "no_clear_difference").otherwise(sided)
    findings = e.select(F.concat_ws(".", "part", "a", "b").alias("id"), label.alias("label"), "label_holm")
    gaps = table(spark, sf_dir, "region").select(F.concat(F.lit("g"), "r_regionkey").alias("id"), F.when(F.col("r_regionkey") % 2 == 0, "not_measured").otherwise("proxy_variable").alias("kind"))
    hidden = table(spark, sf_dir, "nation").where("n_nationkey % 10 = 3").select(F.lit("s1.q1").alias("id"), F.col("n_name").alias("grp"))
    return claims.expectations(findings, gaps, hidden, causal=True)


@query("c02_find_variables")
def find_variables(spark, sf_dir):
    """Brands as cards, searched by nation, type and name: id, label, block and values count, by matching blocks; the five best of each."""
    parts = table(spark, sf_dir, "part")
    cards = parts.groupBy(F.col("p_brand").alias("id")).agg(F.min("p_partkey").alias("ordinal"), F.min_by("p_name", "p_partkey").alias("label"), F.min_by("p_type", "p_partkey").alias("block"), F.array_sort(F.collect_set("p_type")).alias("values")).withColumn("section", F.col("block"))  # a catalogue
    asks = parts.select(F.lower("p_name").alias("ask")).unionByName(parts.select(F.lower("p_type").alias("ask"))).distinct()
    return rounded(claims.find_variables(asks, cards, k=5))
