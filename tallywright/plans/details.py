"""Queries of single rules: orders of answers, filters, tests, notes, checks of answers, and readers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.functions import stats
from tallywright.operators import answers, contrasts, estimates, families
from tallywright.sources import files

from .catalogues import _LONG, answers_long
from .claims import REFS, numeric_evidence
from .estimation import _BB, _RB, _SCORE, SHARES, WHI, WLO, rounded
from .packages import REC, numeric_references, owners, packs, records
from .registry import ORACLES, query, table
from .reviews import _OWNED
from .study import ORDERS, SQL, respondents

_DEBT = "SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS k FROM customer GROUP BY 1"


def debts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"))


# catalogues
@query("c03_stored_categories", "SELECT o_orderpriority AS answer, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE 5 END, o_orderpriority) AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def stored_categories(spark, sf_dir):
    """Ranked answers in their order, then the others by name."""
    seen = table(spark, sf_dir, "orders").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("seen"))  # answers of a codebook
    scale = F.array(*map(F.lit, ORDERS.scales["priority"]))
    ordered = F.concat(F.array_intersect(scale, "seen"), F.array_except("seen", scale))
    return seen.select(F.posexplode(ordered).alias("i", "answer")).select("answer", (F.col("i") + 1).cast("long").alias("place"))


@query("c17_synthesis_input", "SELECT l_orderkey, CAST(json_object('claim', l_orderkey, 'evidence', variables) AS VARCHAR) AS input FROM (" + ORACLES["c08_numeric_evidence"] + ")")
def synthesis_input(spark, sf_dir):
    return numeric_evidence(spark, sf_dir).select("l_orderkey", F.to_json(F.struct(F.col("l_orderkey").alias("claim"), F.col("variables").alias("evidence"))).alias("input"))


# filters
@query("f05_or_complete_cases", SQL + f" SELECT count(*) FILTER ({_BB}) AS left_universe, count(*) FILTER ({_RB}) AS right_universe, count(*) FILTER ({_BB} AND {_RB}) AS universe, count(*) FILTER ({_BB} AND {_RB} AND (balance = 'high' OR ret_a)) AS selected FROM r")
def or_complete_cases(spark, sf_dir):
    """Either of two filters, among those whom both observed."""
    a, b = ORDERS.where("balance", ["high"]), ORDERS.where("ret_a", [True])
    both = a | b
    return respondents(spark, sf_dir).agg(F.count_if(a.universe).alias("left_universe"), F.count_if(b.universe).alias("right_universe"), F.count_if(both.universe).alias("universe"), F.count_if(both.mask).alias("selected"))


@query("f08_ordered_base", SQL + " SELECT region, count(priority) AS base, count(*) FILTER (priority <> '4-NOT SPECIFIED') AS ordered_base FROM r GROUP BY 1")
def ordered_base(spark, sf_dir):
    return respondents(spark, sf_dir).groupBy("region").agg(F.count_if(ORDERS.base("priority")).alias("base"), F.count_if(ORDERS.ordered_base("priority")).alias("ordered_base"))


@query("f09_named_groups", SQL + f", g AS (SELECT CASE WHEN segment IN ('BUILDING','MACHINERY') THEN 'heavy' ELSE 'light' END AS grp, * FROM r WHERE segment IN ('BUILDING','MACHINERY','HOUSEHOLD')), c AS (SELECT grp, count(*) FILTER ({_BB}) AS n, count(*) FILTER (balance = 'low') AS k FROM g GROUP BY 1) SELECT grp, {SHARES} FROM c")
def named_groups(spark, sf_dir):
    """Groups of several answers under one label; answers that no label has are left out."""
    groups = ORDERS.groups("segment", {"heavy": ["BUILDING", "MACHINERY"], "light": ["HOUSEHOLD"]})
    return rounded(estimates.proportion(respondents(spark, sf_dir), ORDERS, "balance", "low", groups))


@query("f10_everyone", SQL + f", c AS (SELECT 'All observed respondents' AS grp, count(status) AS n, count(*) FILTER (status = 'O') AS k FROM r) SELECT grp, {SHARES} FROM c")
def everyone(spark, sf_dir):
    return rounded(estimates.proportion(respondents(spark, sf_dir), ORDERS, "status", "O"))


_TREES = {"open_low": {"and": [{"eq": {"variable": "status", "value": "O"}}, {"eq": {"variable": "balance", "value": "low"}}]}, "not_asia": {"not": {"eq": {"variable": "region", "value": "ASIA"}}}}


@query("f12_contract_groups", SQL + f", c AS (SELECT 'open_low' AS grp, count(*) FILTER (priority <> '4-NOT SPECIFIED' AND status = 'O' AND balance = 'low') AS n, count(*) FILTER (priority IN ('1-URGENT','2-HIGH') AND status = 'O' AND balance = 'low') AS k FROM r UNION ALL SELECT 'not_asia', count(*) FILTER (priority <> '4-NOT SPECIFIED' AND region <> 'ASIA'), count(*) FILTER (priority IN ('1-URGENT','2-HIGH') AND region <> 'ASIA') FROM r) SELECT grp, {SHARES} FROM c")
def contract_groups(spark, sf_dir):
    """Groups given as filter trees."""
    return rounded(estimates.top_box(respondents(spark, sf_dir), ORDERS, "priority", 2, {k: ORDERS.tree(t) for k, t in _TREES.items()}))


@query("f15_under_cap", "SELECT doc_id, n_words, n_words <= 500 AS kept FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) AS n_words FROM documents)")
def under_cap(spark, sf_dir):
    """Whole examples under a cap of words, and those that are left out."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ ]+")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words")).withColumn("kept", F.col("n_words") <= 500)


@query("f17_longest_first", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_first(spark, sf_dir):
    """The 25 longest examples: the limit is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


# estimates
@query("a05_tied_ranks", "SELECT p_brand, p_type, n, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS place FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)")
def tied_ranks(spark, sf_dir):
    each = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("place", F.rank().over(W.partitionBy("p_brand").orderBy(F.desc("n"))).cast("long"))


@query("a08_group_sizes", SQL + " SELECT region AS grp, count(*) AS size, count(*) FILTER (status = 'O') AS among_open FROM r WHERE region IS NOT NULL GROUP BY 1")
def group_sizes(spark, sf_dir):
    """Members of each group whatever they answered elsewhere."""
    among = ORDERS.where("status", ["O"])
    return respondents(spark, sf_dir).where(ORDERS.base("region")).groupBy(F.col("region").alias("grp")).agg(F.count(F.lit(1)).alias("size"), F.count_if(among.mask).alias("among_open"))


@query("a15_marginals", SQL + f", l AS ({_LONG}) SELECT variable, v AS answer, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY variable), 8) AS share FROM l WHERE base AND v IS NOT NULL GROUP BY 1, 2")
def marginals(spark, sf_dir):
    each = answers_long(spark, sf_dir).where("base and v is not null").groupBy("variable", F.col("v").alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(each.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("variable"))))


@query("a18_slice_diversity", _OWNED + "SELECT owner, dim, tag, count(*) AS n FROM (SELECT owner, 'status' AS dim, o_orderstatus AS tag FROM o JOIN orders USING (o_orderkey) UNION ALL SELECT owner, 'priority', o_orderpriority FROM o JOIN orders USING (o_orderkey)) GROUP BY 1, 2, 3")
def slice_diversity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(owners(spark, sf_dir).select("o_orderkey", "owner").hint("merge"), "o_orderkey")
    tags = F.array(F.struct(F.lit("status").alias("dim"), F.col("o_orderstatus").alias("tag")), F.struct(F.lit("priority").alias("dim"), F.col("o_orderpriority").alias("tag")))
    return o.select("owner", F.inline(tags)).groupBy("owner", "dim", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("a22_capability_matrix", _OWNED + "SELECT l_returnflag AS op, count(*) FILTER (owner = 'train') AS train, count(*) FILTER (owner = 'validation') AS validation, count(*) FILTER (owner = 'test') AS test FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY 1")
def capability_matrix(spark, sf_dir):
    """Uses of each operation by split."""
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("op")).join(owners(spark, sf_dir).select("o_orderkey", "owner").hint("merge"), "o_orderkey")
    return used.groupBy("op").pivot("owner", ["train", "validation", "test"]).count().select("op", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("train", "validation", "test")])


# tests
@query("t01_wilson", f"SELECT nation, n, k, round({WLO('k', 'n')}, 8) AS lo, round({WHI('k', 'n')}, 8) AS hi FROM ({_DEBT})")
def wilson(spark, sf_dir):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return rounded(debts(spark, sf_dir).withColumns({"lo": lo, "hi": hi}))


@query("t07_cohens_h", f"SELECT nation, round(2 * asin(sqrt(k / n::DOUBLE)) - 2 * asin(sqrt(0.1)), 8) AS h FROM ({_DEBT})")
def cohens_h(spark, sf_dir):
    """The effect of each nation's share against a tenth."""
    return rounded(debts(spark, sf_dir).select("nation", stats.cohens_h(F.col("k") / F.col("n"), F.lit(0.1)).alias("h")))


@query("t19_group_trend", SQL + f", q AS (SELECT {_SCORE}::DOUBLE AS y, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS x FROM r WHERE {_SCORE} IS NOT NULL AND status IS NOT NULL) SELECT count(*) AS n, round(regr_slope(y, x), 8) AS slope FROM q")
def group_trend(spark, sf_dir):
    """Slope of a score over three ordered groups."""
    y = estimates.score(ORDERS, "priority").cast("double")
    x = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2)
    sums = respondents(spark, sf_dir).where(ORDERS.ordered_base("priority") & ORDERS.base("status")).groupBy(x.alias("position")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    return rounded(contrasts.trend(sums).select("n", "slope"))


@query("t22_readable_labels", SQL + " SELECT CASE WHEN ret_r THEN 'selected' ELSE 'not selected' END AS label, count(*) AS n FROM r WHERE ret_a IS NOT NULL OR ret_n IS NOT NULL OR ret_r IS NOT NULL GROUP BY 1")
def readable_labels(spark, sf_dir):
    return respondents(spark, sf_dir).where(ORDERS.base("ret_r")).groupBy(F.when(F.col("ret_r"), "selected").otherwise("not selected").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("t24_unavailable", f"SELECT nation, CASE WHEN n >= 60 THEN round(k / n::DOUBLE, 8) END AS value, CASE WHEN n < 60 THEN 'SmallBase' END AS reason FROM ({_DEBT})")
def unavailable(spark, sf_dir):
    """A test that can't be had is a row with its reason."""
    small = F.col("n") < 60
    reason = F.split(F.when(small, F.format_string("SmallBase: %d respondents", "n")), ":")[0]
    return rounded(debts(spark, sf_dir).select("nation", F.when(~small, F.col("k") / F.col("n")).alias("value"), reason.alias("reason")))


@query("t27_evidence_direction", f"SELECT nation, CASE WHEN {WLO('k', 'n')} > 0.1 THEN 'supports' WHEN {WHI('k', 'n')} < 0.1 THEN 'contradicts' ELSE 'open' END AS direction FROM ({_DEBT})")
def evidence_direction(spark, sf_dir):
    """What a share says of the fixed assertion that it is over a tenth."""
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return debts(spark, sf_dir).select("nation", F.when(lo > 0.1, "supports").when(hi < 0.1, "contradicts").otherwise("open").alias("direction"))


# evidence notes
@query("l02_evidence_notes", f"WITH d AS ({_DEBT}) SELECT nation, 1 AS seq, 'subclaim' AS kind, 'Nation ' || nation AS text FROM d UNION ALL SELECT nation, 2, 'gap', 'fewer than 60 respondents' FROM d WHERE n < 60 UNION ALL SELECT nation, 3, 'proxy', 'balance below zero stands for debt' FROM d UNION ALL SELECT nation, 4, 'caveat', 'Some refused.' FROM d WHERE k > 0")
def evidence_notes(spark, sf_dir):
    """Subclaims, gaps, proxies and caveats as rows of one log; a caveat has at most 200 characters."""
    note = lambda i, kind, text, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")))
    log = F.array(note(1, "subclaim", F.concat(F.lit("Nation "), "nation")), note(2, "gap", F.lit("fewer than 60 respondents"), F.col("n") < 60), note(3, "proxy", F.lit("balance below zero stands for debt")), note(4, "caveat", F.lit("Some refused."), F.col("k") > 0))
    rows = debts(spark, sf_dir).select("nation", F.inline(F.array_compact(log)))
    return rows.withColumn("text", F.when((F.col("kind") == "caveat") & (F.length("text") > 200), F.raise_error(F.lit("CaveatTooLong"))).otherwise(F.col("text")))


@query("l06_effect_signs", f"SELECT nation, scale, CASE WHEN x > 0 THEN 'up' WHEN x < 0 THEN 'down' ELSE 'none' END AS direction FROM (SELECT nation, scale, CASE scale WHEN 'difference' THEN k / n::DOUBLE - 0.1 WHEN 'odds_ratio' THEN ln((k + 0.5) / (n - k + 0.5) * 9) END AS x FROM ({_DEBT}), (VALUES ('difference'), ('odds_ratio'), ('cramers_v')) s(scale))")
def effect_signs(spark, sf_dir):
    """Signs of effects: of the logarithm for ratios, none for strengths."""
    k, n = F.col("k"), F.col("n")
    effects = {"difference": k / n - 0.1, "odds_ratio": F.ln((k + 0.5) / (n - k + 0.5) * 9), "cramers_v": F.lit(None)}
    rows = debts(spark, sf_dir).select("nation", F.inline(F.array(*[F.struct(F.lit(s).alias("scale"), x.cast("double").alias("x")) for s, x in effects.items()])))
    return rows.select("nation", "scale", F.when(F.col("x") > 0, "up").when(F.col("x") < 0, "down").otherwise("none").alias("direction"))


# checks of answers
@query("k20_outcomes", REC + "SELECT record_id, CASE WHEN output = '' THEN 'empty' WHEN length(output) > 2000 THEN 'truncated' WHEN NOT contains(output, '.') THEN 'malformed' ELSE 'complete' END AS outcome FROM rec")
def outcomes(spark, sf_dir):
    out = F.col("output")
    return records(spark, sf_dir).select("record_id", F.when(out == "", "empty").when(F.length(out) > 2000, "truncated").when(~F.contains(out, F.lit(".")), "malformed").otherwise("complete").alias("outcome"))


@query("k23_corpus_loss", "SELECT l_linestatus AS run, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 8) AS perplexity, round(count(*) FILTER (l_returnflag = 'A') / count(*)::DOUBLE, 8) AS accuracy FROM lineitem GROUP BY 1")
def corpus_loss(spark, sf_dir):
    """Loss by token, its perplexity and accuracy, from rows of cases."""
    loss = F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")
    return rounded(table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("run")).agg(loss.alias("loss"), F.exp(loss).alias("perplexity"), (F.count_if(F.col("l_returnflag") == "A") / F.count(F.lit(1))).alias("accuracy")))


@query("k38_missing_points", "WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events) SELECT user_id, event_type FROM u, t EXCEPT SELECT user_id, event_type FROM events")
def missing_points(spark, sf_dir):
    """Kinds of events that a user has none of."""
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.collect_set("event_type").alias("kinds"))  # one row of a few kinds
    seen = e.groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return seen.crossJoin(F.broadcast(kinds)).select("user_id", F.explode(F.array_except("kinds", "seen")).alias("event_type"))


@query("j07_suite_sources", REC + "SELECT split, source, count(*) AS n, (split = 'train') = (source = 'synthetic') AS allowed FROM (SELECT split, CASE WHEN split = 'train' OR turn % 4 = 0 THEN 'synthetic' ELSE 'client' END AS source FROM sp WHERE split <> 'validation') GROUP BY 1, 2")
def suite_sources(spark, sf_dir):
    """Sources by split: training takes synthetic records only, the test split those of clients only."""
    source = F.when((F.col("split") == "train") | (F.col("turn") % 4 == 0), "synthetic").otherwise("client")
    each = records(spark, sf_dir).where("split <> 'validation'").groupBy("split", source.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("allowed", (F.col("split") == "train") == (F.col("source") == "synthetic"))


# families and views
@query("g04_meaning_hashes", "SELECT l_orderkey, sha256(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)) AS meaning FROM lineitem GROUP BY 1")
def meaning_hashes(spark, sf_dir):
    """One hash for the same groups in any order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ","), 256).alias("meaning"))


@query("g07_study_independent_owners", REC + "SELECT input_hash, CASE WHEN v < 0.7 THEN 'train' ELSE 'test' END AS owner, n FROM (SELECT sha256('[\"core\", \"' || md5(input) || '\"]') AS input_hash, ('0x' || substr(sha256('[\"core\", \"' || md5(input) || '\"]'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS v, count(*) AS n FROM rec GROUP BY 1, 2)")
def study_independent_owners(spark, sf_dir):
    """The same question has one owner, whatever conversation it is in."""
    h = families.digest(F.lit("core"), F.md5(F.col("input").cast("binary")))
    each = records(spark, sf_dir).groupBy(h.alias("input_hash")).agg(F.count(F.lit(1)).alias("n"))
    return each.select("input_hash", families.owner(F.col("input_hash"), {"train": 0.7, "test": 0.3}).alias("owner"), "n")


@query("g18_scaled_requirements", "SELECT p_type, count(*) AS have, ceil(count(DISTINCT p_brand) * 1.5)::BIGINT AS need, count(*) >= ceil(count(DISTINCT p_brand) * 1.5) AS met FROM part GROUP BY 1")
def scaled_requirements(spark, sf_dir):
    """Least numbers scaled by a factor and rounded up, against what there is."""
    each = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("have"), F.ceil(F.count_distinct("p_brand") * 1.5).alias("need"))
    return each.withColumn("met", F.col("have") >= F.col("need"))


@query("m04_accepted_view", REC + "SELECT record_id, input, split FROM sp WHERE length(output) >= length(input)")
def accepted_view(spark, sf_dir):
    """Accepted records with unchanged inputs, checked against the source before they are given."""
    r = records(spark, sf_dir)
    view = r.where(F.length("output") >= F.length("input")).select("record_id", "input", "split")
    changed = view.select("record_id", "input").exceptAll(r.select("record_id", "input"))
    at = files.shared_folder(spark, "accepted")
    if not files.publish(view, at, changed):
        raise ValueError("ViewChanged: inputs differ from the source")
    return spark.read.parquet(at)


# readers
@query("io04_torn_lines", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def torn_lines(spark, sf_dir):
    """Events as JSON lines, read by the reader that drops a cut last line."""
    at = files.shared_folder(spark, "lines")
    files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type"), at)
    return files.read_torn(spark, at, "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("io06_codebook_csv", "SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS blank FROM part GROUP BY 1")
def codebook_csv(spark, sf_dir):
    """A codebook as CSV; missing cells are read as empty text."""
    at = files.shared_folder(spark, "codebook")
    table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") <= 25, F.col("p_type")).alias("allowed")).write.option("header", True).csv(at)
    book = spark.read.schema("p_brand string, allowed string").option("header", True).csv(at).na.fill("")
    return book.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("allowed") == "").alias("blank"))


@query("io08_request_ledgers", "SELECT event_type AS role, count(*) AS calls, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS tokens FROM events GROUP BY 1")
def request_ledgers(spark, sf_dir):
    """Ledgers in folders by role, read by one scan; calls and tokens are summed from their JSON."""
    at = files.shared_folder(spark, "ledgers")
    table(spark, sf_dir, "events").select("event_type", "props").write.partitionBy("event_type").json(at)
    usage = F.from_json("props", "map<string,long>")
    return spark.read.schema("props string, event_type string").json(at).groupBy(F.col("event_type").alias("role")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.element_at(usage, "k")).alias("tokens"))


@query("io07_case_files", "SELECT c_nationkey AS nation, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1")
def case_files(spark, sf_dir):
    """Files of cases in folders, read by a glob; which folder a case is from comes from its path."""
    at = files.shared_folder(spark, "cases")
    table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").write.partitionBy("c_nationkey").json(at)
    rows = spark.read.schema("c_custkey long").json(f"{at}/c_nationkey=*/part-*.json").select("c_custkey", F.regexp_extract(F.col("_metadata.file_path"), "c_nationkey=([0-9]+)/", 1).cast("int").alias("nation"))
    return rows.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))


# specs and plans
@query("v14_impossible_policies", "SELECT p_brand AS axis, sum(least_n)::BIGINT AS least_n, sum(n)::BIGINT AS size FROM (SELECT p_brand, p_type, count(*) AS n, ceil(count(*) / 2.0) + 1 AS least_n FROM part GROUP BY 1, 2) GROUP BY 1 HAVING sum(least_n) > 0.6 * sum(n)")
def impossible_policies(spark, sf_dir):
    """Axes whose minima sum up to more than the size of the selection."""
    each = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("axis"), "p_type").agg(F.count(F.lit(1)).alias("n"), (F.ceil(F.count(F.lit(1)) / 2) + 1).alias("m"))
    return each.groupBy("axis").agg(F.sum("m").alias("least_n"), F.sum("n").alias("size")).where("least_n > 0.6 * size")


@query("t25_share_minus_half", f"SELECT nation, CASE WHEN n >= 10 THEN round(k / n::DOUBLE - 0.5, 8) END AS value, CASE WHEN n >= 10 THEN round({WLO('k', 'n')} - 0.5, 8) END AS lo, CASE WHEN n >= 10 THEN round({WHI('k', 'n')} - 0.5, 8) END AS hi FROM ({_DEBT})")
def share_minus_half(spark, sf_dir):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    shown = lambda c: F.when(F.col("n") >= stats.SUPPRESS, c - 0.5)
    return rounded(debts(spark, sf_dir).select("nation", shown(F.col("k") / F.col("n")).alias("value"), shown(lo).alias("lo"), shown(hi).alias("hi")))


@query("l08_unmodified_estimates", f"SELECT nation, nation % 5 <> 0 AS accepted FROM ({_DEBT})")
def unmodified_estimates(spark, sf_dir):
    """Estimates handed in are accepted if this session made them and no value has changed; every fifth one was changed."""
    made = debts(spark, sf_dir).withColumn("seal", families.digest(F.col("nation"), F.col("n"), F.col("k")))
    given = made.select("nation", families.digest(F.col("nation"), F.col("n"), F.when(F.col("nation") % 5 == 0, F.col("k") + 1).otherwise(F.col("k"))).alias("seal"))
    return given.join(made.select("nation", "seal", F.lit(True).alias("ok")), ["nation", "seal"], "left").select("nation", F.coalesce("ok", F.lit(False)).alias("accepted"))


@query("g03_canonical_measures", "SELECT DISTINCT sha256('[\"' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'share' ELSE 'top_box' END || '\", \"' || o_orderpriority || '\", \"' || o_orderstatus || '\"]') AS measure FROM orders")
def canonical_measures(spark, sf_dir):
    """One hash for each measure: its kind, its answer and its group."""
    kind = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "share").otherwise("top_box")
    return table(spark, sf_dir, "orders").select(kind.alias("kind"), "o_orderpriority", "o_orderstatus").distinct().select(families.digest(F.col("kind"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("measure"))


@query("g08_study_seeds", "SELECT c_custkey, ('0x' || substr(sha256('[\"seed\", \"' || c_custkey || '\"]'), 1, 8))::BIGINT AS seed FROM customer")
def study_seeds(spark, sf_dir):
    h = families.digest(F.lit("seed"), F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.conv(F.substring(h, 1, 8), 16, 10).cast("long").alias("seed"))


@query("u03_aliases", REFS + "SELECT p_partkey, id AS variable, CASE WHEN id IS NULL THEN 'UnknownAlias' ELSE '' END AS error FROM part LEFT JOIN ref ON p_size = reference")
def aliases(spark, sf_dir):
    """Integer aliases become variables; one that stands for none is a row with its error."""
    refs = numeric_references(spark, sf_dir).select(F.col("reference").alias("p_size"), F.col("id").alias("variable"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").join(refs.hint("merge"), "p_size", "left").select("p_partkey", "variable", F.when(F.col("variable").isNull(), "UnknownAlias").otherwise("").alias("error"))
