"""Features and levels of studies, claims and programs, and selections that cover what is asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calls that count towards each feature of a program, and the catalogue sizes that divide the levels. Fixed values.
CALLS = {"n_subclaims": ["subclaim"], "n_filters": ["where", "eligible"], "n_groups": ["group"], "n_estimands": ["proportion", "top_box", "mean_score"], "n_comparisons": ["compare"], "n_gap_calls": ["not_measured", "proxy"]}
FEW, MANY = 64, 256


def normal(text: Column) -> Column:
    """Lower case, with anything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def study_features(cards: DataFrame) -> DataFrame:
    """Structural features of each study from cards (study, block, label, answer_type, routed).

    Near duplicates are blocks of a study whose sets of labels, made normal, are equal.
    """
    blocks = cards.groupBy("study", "block").agg(F.md5(F.array_join(F.array_sort(F.collect_set(normal(F.col("label")))), "|")).alias("set"), F.bool_or("routed").alias("routed"), F.bool_or(F.col("answer_type") == "select_all").alias("boxes"))  # the labels of a block
    sets = blocks.groupBy("study", "set").agg(F.count(F.lit(1)).alias("n"), F.count_if("routed").alias("routed"), F.count_if("boxes").alias("boxes"))
    by_block = sets.groupBy("study").agg(F.sum("n").alias("block_count"), F.count_if(F.col("n") > 1).alias("near_duplicate_block_count"), F.sum("routed").alias("routed_block_count"), F.sum("boxes").alias("select_all_block_count"))
    labels = cards.groupBy("study", normal(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    by_label = labels.groupBy("study").agg(F.sum("n").alias("variable_count"), F.count_if(F.col("n") > 1).alias("duplicate_label_group_count"))
    kinds = cards.groupBy("study").agg(F.count_distinct("answer_type").alias("answer_format_count"))
    return by_block.join(by_label.hint("merge"), "study").join(kinds.hint("merge"), "study")


def label_exposed(claim: Column, labels: Column) -> Column:
    """Whether a claim says every label of an array, as words; never so without a label."""
    text = F.concat(F.lit(" "), normal(claim), F.lit(" "))
    return (F.size(labels) > 0) & F.forall(labels, lambda x: F.contains(text, F.concat(F.lit(" "), normal(x), F.lit(" "))))


def q_level(required: Column, exposed: Column, variables: Column) -> Column:
    """How hard a claim is to map: low if it needs nothing, says its labels or has a small catalogue; high if hidden in a large one."""
    return F.when(~required | exposed | (variables <= FEW), "low").when(variables >= MANY, "high").otherwise("medium")


def program_features(program: Column, contract: Column) -> dict[str, Column]:
    """Features of a program's text, by its calls, and of its contract.

    contract: a struct of recodes (array of arrays of values), variable_groups (count), thresholds (count), relation_depth.
    """
    calls = lambda names: reduce(lambda a, b: a + b, [F.regexp_count(program, F.lit(rf"\b{n}\s*\(")) for n in names])
    out = {k: calls(names).cast("long") for k, names in CALLS.items()}
    out["n_filters"] = out["n_filters"] + F.regexp_count(program, F.lit("among="))
    out["n_recodes"] = F.size(F.array_distinct(F.filter(contract["recodes"], lambda x: F.size(x) >= 2))).cast("long")
    out["variable_defined_groups"], out["n_threshold_comparisons"], out["relation_depth"] = contract["variable_groups"], contract["thresholds"], contract["relation_depth"]
    out["api_operations"] = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(program, F.lit(r"\b([A-Za-z_][A-Za-z_0-9]*)\s*\("), F.lit(1)))), ",")
    return out


def p_level() -> Column:
    """How hard a program is, from the columns of program_features."""
    c = F.col
    high = (c("n_subclaims") >= 3) | ((c("n_estimands") >= 2) & ((c("n_filters") > 0) | (c("variable_defined_groups") > 0) | (c("n_gap_calls") >= 2)))
    low = (c("n_estimands") <= 1) & (c("n_subclaims") <= 1) & (c("n_filters") + c("n_recodes") + c("n_gap_calls") == 0)
    return F.when(high, "high").when(low, "low").otherwise("medium")


def attained(tagged: DataFrame, needs: DataFrame) -> DataFrame:
    """(requirement, minimum, attained, met): how many of tagged (id, tags) have all tags of each of needs (requirement, minimum).

    A requirement is one tag or several joined by &; needs is a table of settings, and is broadcast. tags: an array.
    """
    asked = F.broadcast(needs.withColumn("all_of", F.split("requirement", "&")).withColumn("any_of", F.element_at(F.col("all_of"), 1)))  # rows of settings
    hits = tagged.select("id", "tags", F.explode("tags").alias("any_of")).join(asked, "any_of").where(F.size(F.array_except("all_of", "tags")) == 0)
    n = hits.groupBy("requirement").agg(F.count_distinct("id").alias("attained"))
    found = needs.join(n.hint("merge"), "requirement", "left").withColumn("attained", F.coalesce("attained", F.lit(0)).cast("long"))
    return found.withColumn("met", F.col("attained") >= F.col("minimum"))


def envelope(rows: DataFrame, features: list[str], inside: Column) -> DataFrame:
    """(feature, lo, hi, n, n_inside): the range of each feature in the rows of inside, and how many of the others lie in it."""
    long = rows.select(inside.alias("own"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    ranges = long.where("own").groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    others = long.where("not own").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("k"))
    joined = others.join(F.broadcast(ranges), "feature")  # a row for each feature
    return joined.groupBy("feature", "lo", "hi").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("x").between(F.col("lo"), F.col("hi")), F.col("k")).otherwise(0)).alias("n_inside"))


def token_batches(rows: DataFrame, window: str, key: list[str], budget: int, most: int) -> DataFrame:
    """(window, key, size, batch): inside each window, longest first, a batch grows while rows times width keep the budget, up to most rows.

    rows: (window, key, size). A window is the rows of one update, so a group is small; its first row is its widest, as rows come
    longest first.
    """
    import pandas as pd

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", *key], ascending=[False, *[True] * len(key)])
        out, batch, width, held = [], 0, 0, 0
        for size in rows["size"].tolist():
            if held and (held == most or max(width, size) * (held + 1) > budget):
                batch, width, held = batch + 1, 0, 0
            width, held = max(width, size), held + 1
            out.append(batch)
        return rows.assign(batch=out)[[window, *key, "size", "batch"]]

    kinds = dict(rows.dtypes)
    return rows.select(window, *key, "size").groupBy(window).applyInPandas(cut, ", ".join([f"{c} {kinds[c]}" for c in (window, *key, "size")] + ["batch int"]))
