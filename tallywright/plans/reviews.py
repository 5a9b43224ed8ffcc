"""Queries of written answers, reviews, gates and package audits."""

from __future__ import annotations

from pyspark.sql import functions as F


from tallywright.operators import audits, contrasts, estimates, families
from tallywright.operators.numbering import numbered
from tallywright.sources import files

from .claims import FACTS, facts
from .estimation import _CNT, rounded
from .packages import OWN, REC, owners, records
from .registry import query, table
from .study import ORDERS, SQL, respondents


def segment_pairs(spark, sf_dir):
    """The contrasts of low balances between all pairs of segments."""
    f = ORDERS.where("balance", ["low"])
    return contrasts.compare(estimates.counts(respondents(spark, sf_dir), f.universe, f.mask, ORDERS.groups("segment")), ">")


# facts and answers
_SAYS = "CASE WHEN lo > 0 THEN 'is higher than' WHEN hi < 0 THEN 'is lower than' ELSE 'is not clearly different from' END"


@query("k03_propositions", _CNT + f" SELECT a || ' (' || ka || ' of ' || na || ') ' || {_SAYS} || ' ' || b || ' (' || kb || ' of ' || nb || ')' AS text FROM i")
def propositions(spark, sf_dir):
    says = F.when(F.col("lo") > 0, "is higher than").when(F.col("hi") < 0, "is lower than").otherwise("is not clearly different from")
    return segment_pairs(spark, sf_dir).select(F.format_string("%s (%d of %d) %s %s (%d of %d)", "a", "ka", "na", says, "b", "kb", "nb").alias("text"))


@query("k06_evidence_values", _CNT + " SELECT DISTINCT kind, round(value, 8) AS value FROM (SELECT 'count' AS kind, unnest([na, ka, nb, kb])::DOUBLE AS value FROM i UNION ALL SELECT 'share', unnest([pa, pb]) FROM i UNION ALL SELECT 'real', unnest([pa - pb, lo, hi]) FROM i)")
def evidence_values(spark, sf_dir):
    """Every count, share and real number that a pack may be quoted for."""
    pick = lambda kind, *cols: F.struct(F.lit(kind).alias("kind"), F.array(*[c.cast("double") for c in cols]).alias("values"))
    c = F.col
    pools = F.array(pick("count", c("na"), c("ka"), c("nb"), c("kb")), pick("share", c("ka") / c("na"), c("kb") / c("nb")), pick("real", c("value"), c("lo"), c("hi")))
    return rounded(segment_pairs(spark, sf_dir).select(F.inline(pools)).select("kind", F.explode("values").alias("value"))).distinct()


@query("k07_label_numbers", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(p_name || ' ' || p_brand || ' ' || p_type, '[0-9]+'))), ',') AS numbers FROM part")
def label_numbers(spark, sf_dir):
    """Numbers in the string leaves of a nested label."""
    label = F.to_json(F.struct("p_name", F.struct("p_brand", "p_type").alias("inner")))
    leaves = F.regexp_extract_all(label, F.lit(r':"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(leaves, " "), F.lit("[0-9]+"), F.lit(0)))), ",").alias("numbers"))


_UNIT, _CMP = "[0-9](%| percent| points)", "(more than|less than|at least|at most|over|under) [0-9]"


@query("k08_number_tokens", f"SELECT doc_id, len(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)?')) AS n_numbers, len(regexp_extract_all(t, '{_UNIT}')) AS n_with_unit, len(regexp_extract_all(t, '{_CMP}')) AS n_with_comparator FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\[[a-z0-9]+\\.r[0-9]+\\]', ' ', 'g') AS t FROM documents)")
def number_tokens(spark, sf_dir):
    """Numbers of every text, with units and comparators, after identifiers are blanked out."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\[[a-z0-9]+\.r[0-9]+\]", " ")
    n = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", n(r"[0-9]+(\.[0-9]+)?").alias("n_numbers"), n(_UNIT).alias("n_with_unit"), n(_CMP).alias("n_with_comparator"))


@query("k14_verdict_validity", "SELECT l_orderkey, count(*) FILTER (times = 0) AS missing, count(*) FILTER (times > 1) AS repeated, bool_and(times = 1) AS valid FROM (SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' AND l_quantity > 45 THEN 2 ELSE 1 END) AS times FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def verdict_validity(spark, sf_dir):
    """Order and line number as items; a verdict lacks for some and is given twice for others. Valid: each item once, nothing else."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    given = lines.where("l_returnflag <> 'N'")
    verdicts = given.unionByName(given.where("l_returnflag = 'A' and l_quantity > 45")).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("times"))
    both = lines.select("l_orderkey", "l_linenumber").distinct().withColumn("item", F.lit(True)).join(verdicts.hint("merge"), ["l_orderkey", "l_linenumber"], "full_outer")
    found = both.groupBy("l_orderkey").agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("item").isNull()).alias("unknown"))
    return found.select("l_orderkey", "missing", "repeated", ((F.col("missing") + F.col("repeated") + F.col("unknown")) == 0).alias("valid"))


@query("k16_review_payload", FACTS + "SELECT kind, CAST(json_object('kind', kind, 'facts', list(text ORDER BY text)) AS VARCHAR) AS payload FROM f GROUP BY 1")
def review_payload(spark, sf_dir):
    each = facts(spark, sf_dir).groupBy("kind").agg(F.array_sort(F.collect_list("text")).alias("facts"))  # facts of one pack
    return each.select("kind", F.to_json(F.struct("kind", "facts")).alias("payload"))


@query("k17_contract_match", _CNT + " SELECT x.grp AS a, y.grp AS b, coalesce(bool_or(CASE WHEN i.a = x.grp THEN pa > pb ELSE pb > pa END), false) AS matched FROM c x JOIN c y ON x.grp <> y.grp LEFT JOIN i ON (i.a = x.grp AND i.b = y.grp) OR (i.a = y.grp AND i.b = x.grp) GROUP BY 1, 2")
def contract_match(spark, sf_dir):
    """Required comparisons, found by the respondents of both sides rather than by labels; a reversed pair needs the reversed direction."""
    who = respondents(spark, sf_dir).where(ORDERS.base("segment")).groupBy(F.col("segment").alias("grp")).agg(F.struct(F.count(F.lit(1)), estimates.fingerprint(F.col("respondent_id"))).alias("who"))
    x, y = who.toDF("a", "wa"), who.toDF("b", "wb")
    required = x.join(F.broadcast(y), F.col("a") != F.col("b")).withColumn("direction", F.lit("higher"))  # one row for each group of the codebook
    found = segment_pairs(spark, sf_dir).select("a", "b", F.when(F.col("value") > 0, "higher").when(F.col("value") < 0, "lower").alias("direction")).join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    turned = F.when(F.col("direction") == "higher", "lower").when(F.col("direction") == "lower", "higher")
    either = found.select("wa", "wb", "direction").unionByName(found.select(F.col("wb").alias("wa"), F.col("wa").alias("wb"), turned.alias("direction"))).distinct()
    return required.join(either.withColumn("hit", F.lit(True)).hint("merge"), ["wa", "wb", "direction"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("matched"))


# gates and summaries
_NEED = "(VALUES ('click', 0.3), ('error', 0.3), ('purchase', 0.9), ('recall', 0.1)) q(kind, need)"


@query("k27_calibration_gate", f"SELECT kind, need::DOUBLE AS need, round(rate, 8) AS rate, coalesce(rate >= need, false) AS met FROM {_NEED} LEFT JOIN (SELECT event_type AS kind, avg((value > 50)::INT) AS rate FROM events GROUP BY 1) USING (kind)")
def calibration_gate(spark, sf_dir):
    """Required rates by kind; a kind without any review isn't met."""
    needs = F.create_map(*[F.lit(x) for kv in (("click", 0.3), ("error", 0.3), ("purchase", 0.9), ("recall", 0.1)) for x in kv])
    seen = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.avg((F.col("value") > 50).cast("int")).alias("rate"))
    rates = seen.agg(F.map_from_entries(F.collect_list(F.struct("kind", "rate"))).alias("rates"))  # one row of kinds
    gate = rates.select("rates", F.explode(needs).alias("kind", "need")).select("kind", "need", F.try_element_at("rates", "kind").alias("rate"))
    return rounded(gate.withColumn("met", F.coalesce(F.col("rate") >= F.col("need"), F.lit(False))))


@query("k33_combined_review", "SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS first_passed, count(*) FILTER (toxic = 0) AS second_passed, count(*) FILTER (quality = 1 AND toxic = 0) AS both_passed FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def combined_review(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("first_passed"), F.count_if(b).alias("second_passed"), F.count_if(a & b).alias("both_passed"))


@query("k34_two_review_table", REC + "SELECT coalesce(variant, 'all') AS variant, count(*) AS submitted, count(*) FILTER (a) AS first_passed, count(*) FILTER (a AND b) AS passed FROM (SELECT CASE WHEN turn % 4 = 0 THEN 'template' ELSE 'paraphrase' END AS variant, length(output) >= length(input) AS a, contains(output, '.') AS b FROM rec) GROUP BY ROLLUP (variant)")
def two_review_table(spark, sf_dir):
    """Two reviews of the same records, joined, by claim variant and for all."""
    r = records(spark, sf_dir)
    first = r.select("record_id", F.when(F.col("turn") % 4 == 0, "template").otherwise("paraphrase").alias("variant"), (F.length("output") >= F.length("input")).alias("a"))
    second = r.select("record_id", F.contains("output", F.lit(".")).alias("b"))
    each = first.join(second.hint("merge"), "record_id").rollup("variant").agg(F.count(F.lit(1)).alias("submitted"), F.count_if("a").alias("first_passed"), F.count_if(F.col("a") & F.col("b")).alias("passed"))
    return each.withColumn("variant", F.coalesce("variant", F.lit("all")))


@query("k39_rejection_reasons", "SELECT doc_id, string_agg('number ' || x, '; ' ORDER BY rn) AS reasons FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY x) AS rn FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS x FROM documents)) WHERE rn <= 5 GROUP BY 1")
def rejection_reasons(spark, sf_dir):
    """Numbers of a text that no evidence has, as reasons; five for each text are named, which is the feature."""
    found = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))), 1, 5)
    each = table(spark, sf_dir, "documents").select("doc_id", F.transform(found, lambda x: F.concat(F.lit("number "), x)).alias("r"))
    return each.where(F.size("r") > 0).select("doc_id", F.array_join("r", "; ").alias("reasons"))


# audits
@query("j01_positional_zip", REC + "SELECT row_number() OVER (ORDER BY conv_id, turn) AS pos, length(input) AS n_in, length(output) AS n_out FROM rec")
def positional_zip(spark, sf_dir):
    """Inputs and outputs as files of their own, joined line by line."""
    r = numbered(records(spark, sf_dir), "conv_id", "turn")
    a, b = r.select("pos", F.length("input").cast("long").alias("n_in")), r.select("pos", F.length("output").cast("long").alias("n_out"))
    joined = a.join(b.hint("merge"), "pos", "full_outer")
    uneven = F.col("n_in").isNull() != F.col("n_out").isNull()
    return joined.withColumn("pos", F.when(uneven, F.raise_error(F.lit("files of different length"))).otherwise(F.col("pos")))


@query("j02_accepted_rows", REC + "SELECT record_id, CASE WHEN length(output) < length(input) THEN 'no decision' ELSE 'changed' END AS fault FROM sp WHERE length(output) < length(input) OR contains(output, '%')")
def accepted_rows(spark, sf_dir):
    """Exported rows whose decision lacks, or has another answer than the row."""
    r = records(spark, sf_dir).select("record_id", "input", "output")
    decisions = r.where(F.length("output") >= F.length("input")).select("record_id", F.replace("output", F.lit("%"), F.lit("pct")).alias("answer"))
    joined = r.join(decisions.hint("merge"), "record_id", "left")
    fault = F.when(F.col("answer").isNull(), "no decision").when(F.col("answer") != F.col("output"), "changed")
    return joined.select("record_id", fault.alias("fault")).where("fault is not null")


@query("j05_blocked_families", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def blocked_families(spark, sf_dir):
    """Orders whose customer isn't used by another corpus."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    used = o.where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return o.where("o_orderstatus <> 'P'").join(used.hint("merge"), "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("j09_variant_coverage", "SELECT l_orderkey, count(*) AS variants, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY 1")
def variant_coverage(spark, sf_dir):
    """Variants of a family are numbered from 1 without gap or repeat."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("variants"), F.array_sort(F.collect_set("l_linenumber")).alias("seen"))
    return each.select("l_orderkey", "variants", F.col("seen").eqNullSafe(F.sequence(F.lit(1), F.col("variants").cast("int"))).alias("complete"))


_OWNED = f"WITH f AS ({OWN}), o AS (SELECT o_orderkey, CASE WHEN ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.8 THEN 'train' WHEN ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.9 THEN 'validation' ELSE 'test' END AS owner FROM f) "


@query("j10_isolation", _OWNED + "SELECT l_partkey AS atom, count(DISTINCT owner) AS owners FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT owner) > 1")
def isolation(spark, sf_dir):
    """Atoms that selections of several owners use."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("atom"))
    used = lines.join(owners(spark, sf_dir).select("o_orderkey", "owner").hint("merge"), "o_orderkey")
    return used.groupBy("atom").agg(F.count_distinct("owner").alias("owners")).where("owners > 1")


@query("j11_slice_isolation", _OWNED + "SELECT kind, count(*) AS leaks FROM (SELECT kind, key FROM (SELECT 'customer' AS kind, o_custkey AS key, owner FROM o JOIN orders USING (o_orderkey) UNION ALL SELECT 'order', o_orderkey, owner FROM o UNION ALL SELECT 'nation', c_nationkey, owner FROM o JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2 HAVING count(DISTINCT owner) > 1) GROUP BY 1")
def slice_isolation(spark, sf_dir):
    """Studies, families and records that slices share."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(owners(spark, sf_dir).select("o_orderkey", "owner").hint("merge"), "o_orderkey")
    all_ = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    return audits.split_leaks(all_, {"customer": "o_custkey", "order": "o_orderkey", "nation": "c_nationkey"}, "owner").groupBy("kind").agg(F.count(F.lit(1)).alias("leaks"))


@query("j12_split_plan", _OWNED + "SELECT owner, count(*) AS size, 0::BIGINT AS faults FROM o GROUP BY 1")
def split_plan(spark, sf_dir):
    """A written plan against owners computed anew."""
    now, path = owners(spark, sf_dir).select("o_orderkey", "owner"), files.shared_folder(spark, "plan")
    now.write.parquet(path)
    frozen = spark.read.parquet(path)
    faults = audits.differences(frozen, now).groupBy("owner").agg(F.count(F.lit(1)).alias("faults"))
    return frozen.groupBy("owner").agg(F.count(F.lit(1)).alias("size")).join(faults, "owner", "left").select("owner", "size", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


@query("j14_private_keys", "SELECT event_type, count(*) AS n, count(*) FILTER (list_contains(json_keys(props), 'k')) AS with_private FROM events GROUP BY 1")
def private_keys(spark, sf_dir):
    """Inputs whose JSON shows a private key."""
    seen = F.arrays_overlap(F.json_object_keys("props"), F.array(F.lit("k"), F.lit("answer")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("with_private"))


@query("j17_pairs_in_one_split", REC + ", q AS (SELECT conv_id, turn // 4 AS pair, ('0x' || substr(sha256('[\"record\", \"' || record_id || '\"]'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.5 AS s FROM rec) SELECT conv_id, pair, count(DISTINCT s) AS splits FROM q GROUP BY 1, 2 HAVING count(DISTINCT s) <> 1")
def pairs_in_one_split(spark, sf_dir):
    """Neighbouring records that a split by record, not by family, tears apart."""
    s = families.owner(families.digest(F.lit("record"), F.col("record_id")), {"calibration": 0.5, "evaluation": 0.5})
    r = records(spark, sf_dir).select("conv_id", F.floor(F.col("turn") / 4).alias("pair"), s.alias("s"))
    return r.groupBy("conv_id", "pair").agg(F.count_distinct("s").alias("splits")).where("splits <> 1")
