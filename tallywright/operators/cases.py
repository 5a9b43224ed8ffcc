"""Cases: candidates in stages, blueprints from a catalogue, contracts, and sealed estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .answers import once
from .families import digest, take_by_hash

#: The patterns of blueprints: outcomes besides the main one, population, threshold, who is compared, gaps. Fixed names.
PATTERNS = {
    "group_difference": {}, "majority_threshold": {"threshold": 0.5}, "recode": {"groups": "recode"}, "population_and": {"population": "and"}, "population_or": {"population": "or"}, "population_not": {"population": "not"},
    "variable_defined_groups": {"groups": "variable"}, "observed_eligibility": {"population": "eligible"}, "multiple_outcomes": {"more": 1, "component": "restricted"}, "three_subclaims": {"more": 2}, "proxy_and_gap": {"more": 1, "intent": True, "gaps": ["observed transactions", "causal effect"]},
    "causal_gap": {"gaps": ["causal effect"]}, "population_gap": {"gaps": ["population prevalence"]}, "transport_gap": {"gaps": ["transportability"]}, "historical_gap": {"gaps": ["temporal comparison"]}, "unavailable_transactions": {"analyses": False, "gaps": ["observed transactions"]},
}
INTENT, DEMOGRAPHICS = "purchase intent", "demographics"
#: Scenarios of claims with an analysis, and those that name evidence which is missing. Fixed names.
SCENARIOS, MISSING = ("causal", "population", "behaviour", "media", "transport"), ("transactions", "historical")

CARD = "struct<id:string,block:string,kind:string,vals:array<string>>"
ANALYSIS = "array<struct<component:string,variable:string,operation:string,grouping:string,groups:array<string>,population:string,threshold:double,expect:string>>"


def candidate_stages(analyses: DataFrame, blocked: DataFrame, rules: DataFrame, seed: int, first: int = 24, most: int = 60) -> DataFrame:
    """(stage, scenario, family, cores, keys, claim, availability, labels) of all candidate cases that stay clear of what is blocked.

    analyses: (core, card, block, grouping, groups, answer_type, label, threshold, tested, stable), blocked: (key), rules: (scenario, core), the
    scenarios that fit an analysis. Unstable and blocked analyses are out before anything is counted. Singles: each analysis,
    as a suppression where it isn't tested. Scenarios: tested differences with a rule. Pairs: in each bucket of block, grouping and groups the first `first` differences by seeded hash
    give pairs of different cards, of which the first `most` by hash stay. Context: tested thresholds with a rule of missing evidence name what is missing, unless that is blocked.
    """
    free = analyses.where(F.coalesce("stable", F.lit(False))).join(blocked.select(F.col("key").alias("core")).distinct().hint("merge"), "core", "left_anti")
    tested, threshold = F.coalesce("tested", F.lit(False)), F.coalesce("threshold", F.lit(False))
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, stage: str, scenario: Column, family: Column, cores: Column, keys: Column, claim: str, availability: str, labels: Column) -> DataFrame:
        return df.select(F.lit(stage).alias("stage"), scenario.alias("scenario"), family.alias("family"), cores.alias("cores"), keys.alias("keys"), F.lit(claim).alias("claim"), F.lit(availability).alias("availability"), F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"))

    core = F.array("core")
    out = [rows(free, "single", F.when(tested, "single").otherwise("suppression"), digest(F.col("core")), core, none, "single", "available", F.array("label"))]
    plain = free.where(tested & ~threshold)
    fits = plain.join(rules.where(F.col("scenario").isin(*SCENARIOS)).distinct().hint("merge"), "core")
    out.append(rows(fits, "scenario", F.col("scenario"), digest(F.col("core")), core, none, "linked", "partially_available", F.array("label", F.lit("not_applicable"))))
    few = take_by_hash(plain.withColumn("bucket", digest(F.col("block"), F.col("grouping"), F.col("groups"))), "bucket", "core", seed, F.lit(first)).select("bucket", "core", "card", "label")
    a, b = (few.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("core", "card", "label")]) for x in "ab")
    pairs = a.join(b.hint("merge"), "bucket").where("core_a < core_b and card_a <> card_b").withColumn("pair", F.concat_ws("+", "core_a", "core_b"))  # of `first` rows a bucket
    pairs = take_by_hash(pairs, "bucket", "pair", seed, F.lit(most))
    out.append(rows(pairs, "pair", F.lit("compound"), digest(F.col("core_a"), F.col("core_b")), F.array("core_a", "core_b"), none, "multiple", "available", F.array("label_a", "label_b")))
    missing = free.where(tested & threshold).join(rules.where(F.col("scenario").isin(*MISSING)).distinct().hint("merge"), "core").withColumn("key", digest(F.lit("missing"), F.col("scenario"), F.col("core")))
    missing = missing.join(blocked.select("key").distinct().hint("merge"), "key", "left_anti")
    out.append(rows(missing, "context", F.col("scenario"), F.col("key"), none, F.array("key", "core"), "single", "unavailable", F.array(F.lit("unavailable"))))
    return reduce(DataFrame.unionByName, out)


def blueprints(cards: DataFrame, contrasts: DataFrame, count: int, seed: int) -> DataFrame:
    """Up to count families of claims for each study, the patterns in turn: (study, place, pattern, family, analyses, gaps, proxy, claim).

    cards: (study, ordinal, id, block, section, answer_type, label, vals), a catalogue; contrasts: (study, grouping, place, groups),
    groups being labels of a grouping. A pattern's roles are filled from the study: the main outcome is each card that is no
    demographic one; other outcomes are the first cards of other blocks; a population takes the first and the last demographic card; groups by a variable
    take the first single choice with two answers or more that isn't the main card; a recode takes the first demographic card; a proxy takes the first card about intent. A card for which a role
    can't be filled gives no blueprint of that pattern. Main cards and contrasts come in the order of seeded hashes, equal families once; a study with fewer than
    count families has all of them. The direction of each analysis is a hash of family, component and seed, never of a result.

    A study's roles are one row (its first cards of a kind); a blueprint is a row, and only the join with that row is shuffled.
    """
    card = F.struct("ordinal", "id", "block", F.col("answer_type").alias("kind"), "vals", "label")
    demo = F.col("section") == DEMOGRAPHICS
    per_block = F.row_number().over(W.partitionBy("study", "block").orderBy("ordinal", "id"))
    mains = cards.where(~demo & (F.col("answer_type") != "rank"))
    heads = mains.withColumn("nth", per_block).where("nth <= 2").withColumn("head", F.min("ordinal").over(W.partitionBy("study", "block")))
    heads = heads.withColumn("rank", F.dense_rank().over(W.partitionBy("study").orderBy("head", "block"))).where("rank <= 3")  # two cards of three blocks: enough to find two outside any block
    others = heads.groupBy("study").agg(F.array_sort(F.collect_list(card)).alias("others"))
    least = lambda when: F.min(F.when(when, card))
    single = (F.col("answer_type") == "single") & (F.size("vals") >= 2)
    firsts = mains.withColumn("nth", F.row_number().over(W.partitionBy("study", single).orderBy("ordinal", "id"))).where((F.col("nth") <= 2) & single)
    roles = cards.groupBy("study").agg(least(demo).alias("demo_first"), F.max(F.when(demo, card)).alias("demo_last"), least(F.col("section") == INTENT).alias("intent"))
    roles = roles.join(others.hint("merge"), "study").join(firsts.groupBy("study").agg(F.array_sort(F.collect_list(card)).alias("singles")).hint("merge"), "study", "left")
    patterns = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(p).alias("pattern"), F.lit(x.get("more", 0)).alias("more"), F.lit(x.get("population")).cast("string").alias("population"), F.lit(x.get("groups", "contrast")).alias("who"), F.lit(x.get("threshold")).cast("double").alias("threshold"), F.lit(x.get("intent", False)).alias("proxied"), F.lit(x.get("component")).cast("string").alias("component"), F.lit(x.get("analyses", True)).alias("analysed"), F.array(*map(F.lit, x.get("gaps", []))).cast("array<string>").alias("gaps")) for i, (p, x) in enumerate(PATTERNS.items())])
    each = mains.select("study", card.alias("main")).join(contrasts.select("study", "grouping", F.col("groups").alias("compared"), F.col("place").alias("nth_contrast")).hint("merge"), "study").join(roles.hint("merge"), "study").select("*", F.inline(patterns))

    outside = F.filter("others", lambda x: x["block"] != F.col("main.block"))
    other_single = F.get(F.filter("singles", lambda x: x["id"] != F.col("main.id")), F.lit(0))
    quoted = lambda c: F.concat(c["id"], F.lit("="), F.array_join(c["vals"], "|"))
    restriction = F.when(F.col("demo_first").isNotNull() & (F.size("demo_first.vals") > 0), F.concat(F.col("demo_first.id"), F.lit("="), F.array_join(F.slice("demo_first.vals", 1, 2), "|")))
    last = F.when(F.size("demo_last.vals") > 0, F.concat(F.col("demo_last.id"), F.lit("="), F.get("demo_last.vals", F.lit(0))))
    eligible = F.get(outside, F.lit(0))
    population = F.when(F.col("population").isin("and", "or"), F.concat(F.col("population"), F.lit("("), restriction, F.lit(","), last, F.lit(")"))).when(F.col("population") == "not", F.concat(F.lit("not("), restriction, F.lit(")"))).when(F.col("population") == "eligible", F.concat(F.lit("eligible("), eligible["id"], F.lit(")")))
    split = F.array(F.get(other_single["vals"], F.lit(0)), F.concat(F.lit("not "), F.get(other_single["vals"], F.lit(0))))
    coded = F.when(F.size("demo_first.vals") >= 3, F.array(F.array_join(F.slice("demo_first.vals", 1, 2), "|"), F.array_join(F.slice("demo_first.vals", 3, F.greatest(F.size("demo_first.vals") - 2, F.lit(1))), "|")))
    grouping = F.when(F.col("who") == "variable", other_single["id"]).when(F.col("who") == "recode", F.col("demo_first.id")).otherwise(F.col("grouping"))
    groups = F.when(F.col("who") == "variable", split).when(F.col("who") == "recode", coded).when(F.col("threshold").isNotNull(), F.slice("compared", 1, 1)).otherwise(F.col("compared"))
    outcomes = F.when(F.col("proxied"), F.array("main", "intent")).otherwise(F.concat(F.array("main"), F.slice(outside, 1, F.greatest("more", F.lit(1)))))
    outcomes = F.when(F.col("analysed"), F.slice(outcomes, 1, F.col("more") + 1)).otherwise(F.slice(outcomes, 1, 0))
    filled = F.when(~F.col("analysed"), True).otherwise((F.size(outcomes) == F.col("more") + 1) & F.forall(outcomes, lambda x: x.isNotNull()) & (F.col("population").isNull() | population.isNotNull()) & grouping.isNotNull() & groups.isNotNull() & F.forall(groups, lambda g: g.isNotNull()) & (F.col("component").isNull() | restriction.isNotNull()) & (~F.col("proxied") | (F.col("intent.id") != F.col("main.id"))))
    each = each.withColumns({"grouping_": grouping, "groups_": groups, "population_": population, "outcomes": outcomes, "restriction": restriction}).where(F.coalesce(filled, F.lit(False)))
    operation = lambda c: F.when(c["kind"] == "ordered_scale", "top_box_2").when(c["kind"] == "select_all", "selection").otherwise(F.concat(F.lit("value="), F.coalesce(F.get(c["vals"], F.lit(0)), F.lit(""))))
    bare = F.transform("outcomes", lambda c, i: F.struct(F.concat(F.lit("c"), i + 1).alias("component"), c["id"].alias("variable"), operation(c).alias("operation"), F.col("grouping_").alias("grouping"), F.col("groups_").alias("groups"), F.coalesce("population_", F.when((F.col("component") == "restricted") & (i > 0), F.col("restriction"))).alias("population"), F.col("threshold").alias("threshold"), c["label"].alias("label")))
    each = each.withColumn("bare", bare).withColumn("family", digest(F.col("study"), F.when(F.col("analysed"), F.col("pattern")).otherwise(F.lit("gap")), F.to_json("bare")))
    once = each.dropDuplicates(["study", "family"])  # patterns without an analysis are one family a study
    at = F.row_number().over(W.partitionBy("study", "turn").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "family"), 256)))
    turns = once.withColumn("nth", at).where(F.col("nth") <= count)
    placed = turns.withColumn("place", F.row_number().over(W.partitionBy("study").orderBy("nth", "turn"))).where(F.col("place") <= count)
    up = lambda family, c: F.conv(F.substring(digest(family, c, F.lit(seed)), 1, 8), 16, 10).cast("long") % 2 == 1
    done = placed.withColumn("analyses", F.transform("bare", lambda x: F.struct(*[x[c].alias(c) for c in ("component", "variable", "operation", "grouping", "groups", "population", "threshold")], F.when(up(F.col("family"), x["component"]), ">").otherwise("<").alias("expect"), x["label"].alias("label"))))
    said = F.transform("analyses", lambda x: F.when(x["threshold"].isNotNull(), F.concat(F.when(x["expect"] == ">", "More").otherwise("Fewer"), F.lit(" than half of "), F.get(x["groups"], F.lit(0)), F.lit(" respondents choose '"), x["label"], F.lit("'."))).otherwise(F.concat(F.get(x["groups"], F.lit(0)), F.lit(" respondents choose '"), x["label"], F.lit("' "), F.when(x["expect"] == ">", "more often").otherwise("less often"), F.lit(" than "), F.get(x["groups"], F.lit(1)), F.lit(" respondents."))))
    proxy = F.when(F.col("proxied"), F.col("intent.id"))
    return done.select("study", F.col("place").cast("int").alias("place"), "pattern", "family", F.transform("analyses", lambda x: x.dropFields("label")).alias("analyses"), "gaps", proxy.alias("proxy"), F.array_join(F.concat(said, F.transform("gaps", lambda g: F.concat(F.lit("Not in this study: "), g, F.lit(".")))), " ").alias("claim"))


def relation_depth(relations: Column) -> Column:
    """How deep relations of relations go: 1 where the members are components; relations come after those that they name."""
    start = F.array().cast("array<struct<id:string,depth:int>>")

    def one(seen: Column, r: Column) -> Column:
        inner = F.array_max(F.transform(F.filter(seen, lambda s: F.array_contains(r["members"], s["id"])), lambda s: s["depth"]))
        return F.concat(seen, F.array(F.struct(r["id"].alias("id"), (F.coalesce(inner, F.lit(0)) + 1).cast("int").alias("depth"))))

    return F.coalesce(F.aggregate(relations, start, one, lambda seen: F.array_max(F.transform(seen, lambda s: s["depth"]))), F.lit(0))


#: Contracts as JSON are read back with these.
COMPONENT = "struct<id:string,text:string,estimand:string,scope:string,limitation:string>"
RELATION = "struct<place:int,id:string,kind:string,members:array<string>>"
ANALYSIS_CONTRACT = f"level string, components array<{COMPONENT}>, relations array<{RELATION}>, relation_depth int, required array<struct<component:string,variable:string,operation:string,groups:array<string>,threshold:double,expect:string>>, gaps array<struct<component:string,reason:string>>"
SYNTHESIS_CONTRACT = f"level string, relations array<{RELATION}>, relation_depth int, findings array<struct<component:string,contrast:struct<estimate:string,value:double,label:string>,estimates:array<struct<grp:string,n:bigint,value:double>>,limitation:string>>"


def contracts(components: DataFrame, bindings: DataFrame, relations: DataFrame, contrasts: DataFrame, estimates: DataFrame) -> DataFrame:
    """(case_id, analysis, synthesis): what a case's analysis must show and what its answer must say, as JSON.

    components: (case_id, id, text, estimand, scope, limitation); bindings: (case_id, component, variable, operation, groups, threshold, expect);
    relations: (case_id, place, id, kind, members), members being components or earlier relations; contrasts: (case_id, component, estimate, value, label);
    estimates: (case_id, estimate, grp, n, value). The analysis contract asks for each binding and names the limitation of each component that has one; the synthesis
    contract has for each component its contrast with the estimates of the groups that its binding asks for, or its limitation. The parts of a case meet
    in one row, by one exchange, and are put together there; a case without components has no contract.
    """
    kinds = {
        "components": (components, ["id", "text", "estimand", "scope", "limitation"]),
        "required": (bindings, ["component", "variable", "operation", "groups", "threshold", "expect"]),
        "relations": (relations, ["place", "id", "kind", "members"]),
        "contrasts": (contrasts, ["component", "estimate", "value", "label"]),
        "measured": (estimates, ["estimate", "grp", "n", "value"]),
    }
    none = {k: F.lit(None).cast(df.select(F.struct(*cols).alias("x")).schema["x"].dataType) for k, (df, cols) in kinds.items()}
    parts = [df.where("case_id is not null").select("case_id", *[(F.struct(*cols) if x == k else none[x]).alias(x) for x in kinds]) for k, (df, cols) in kinds.items()]
    # what a row isn't is null, which no list takes up
    whole = reduce(DataFrame.unionByName, parts).groupBy("case_id").agg(*[F.array_sort(F.collect_list(k)).alias(k) for k in kinds]).where(F.size("components") > 0)

    def estimates_of(c: Column, own: Column) -> Column:
        asked = F.flatten(F.transform(F.filter("required", lambda b: b["component"] == c["id"]), lambda b: F.array_distinct(F.coalesce(b["groups"], F.array().cast("array<string>")))))
        times = lambda e, asked: F.size(F.filter(asked, lambda g: g == e["grp"]))  # noqa: E731  once for each binding
        each = lambda t, asked: F.transform(F.filter("measured", lambda e: e["estimate"] == t["estimate"]), lambda e: F.array_repeat(F.struct(e["grp"].alias("grp"), e["n"].alias("n"), e["value"].alias("value")), times(e, asked)))
        return once(asked, lambda asked: F.array_sort(F.flatten(F.transform(own, lambda t: F.flatten(each(t, asked))))))

    def findings(c: Column) -> Column:
        row = lambda contrast, seen, limitation: F.struct(c["id"].alias("component"), contrast.alias("contrast"), F.when(F.size(seen) > 0, seen).alias("estimates"), limitation.alias("limitation"))
        own = F.transform(F.filter("contrasts", lambda t: t["component"] == c["id"]), lambda t: F.struct(t["estimate"].alias("estimate"), t["value"].alias("value"), t["label"].alias("label")))
        said = lambda own: once(estimates_of(c, own), lambda seen: F.when(F.size(own) > 0, F.transform(own, lambda t: row(t, seen, F.lit(None).cast("string")))).otherwise(F.array(row(F.get(own, F.lit(0)), seen, c["limitation"]))))
        return once(own, said)

    gaps = F.transform(F.filter("components", lambda c: c["limitation"].isNotNull()), lambda c: F.struct(c["id"].alias("component"), c["limitation"].alias("reason")))
    whole = whole.withColumns({"depth": relation_depth(F.col("relations")), "gaps": gaps, "found": F.array_sort(F.flatten(F.transform("components", findings)))})
    analysis = F.struct(F.lit("analysis").alias("level"), "components", "relations", F.col("depth").alias("relation_depth"), "required", "gaps")
    synthesis = F.struct(F.lit("synthesis").alias("level"), "relations", F.col("depth").alias("relation_depth"), F.col("found").alias("findings"))
    return whole.select("case_id", F.to_json(analysis).alias("analysis"), F.to_json(synthesis).alias("synthesis"))


def sealed(rows: DataFrame, session: str, pack: str, key: str, values: list[str]) -> DataFrame:
    """rows with session, pack and a seal over both, the key and all values."""
    return rows.withColumns({"session": F.lit(session), "pack": F.lit(pack)}).withColumn("seal", seal(key, values))


def seal(key: str, values: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(F.col("session"), F.col("pack"), F.col(key).cast("string").alias("key"), F.struct(*values).alias("values")), {"ignoreNullFields": "false"}), 256)


def unsealed(handed: DataFrame, made: DataFrame, session: str, pack: str, key: str, values: list[str]) -> DataFrame:
    """handed (sealed rows that come back) with verdict: "" or why a row isn't one that this session put into this pack.

    foreign: of another session or pack. changed: the values aren't those that were sealed. forged: the seal fits the row, but nothing
    made has it. Rows are compared by their seals, of which one side may have any number.
    """
    known = made.select(F.col("seal").alias("own_seal"), F.lit(True).alias("known")).distinct()
    joined = handed.join(known.hint("merge"), handed["seal"] == known["own_seal"], "left")
    away = ~(F.col("session").eqNullSafe(F.lit(session)) & F.col("pack").eqNullSafe(F.lit(pack)))
    verdict = F.when(away, "foreign").when(~F.col("seal").eqNullSafe(seal(key, values)), "changed").when(F.col("known").isNull(), "forged").otherwise("")
    return joined.withColumn("verdict", verdict).drop("own_seal", "known")
