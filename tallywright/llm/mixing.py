"""Mixes sources to target weights by hierarchical budgeting over a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, words

LEVELS = ["domain", "lang", "source"]
#: Weights that the query and the pipeline use; names not listed have the weight of "*".
WEIGHTS = {"domain": {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1, "*": 0.1}, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, "*": 0.05}, "source": {"*": 1.0}}


def domain_of(source: Column) -> Column:
    """The domain of a source: the remainder of its number by four; d0 without a number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.concat(F.lit("d"), (F.when(number == "", F.lit(0)).otherwise(number.try_cast("int")) % 4).cast("string"))


def shared_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Gives each node a share of its parent's budget: in proportion to weight, up to capacity.

    What a node can't take goes to its siblings; a parent's budget is never over the sum of its nodes'
    capacities, so nothing is left for the parent's siblings that had room below it. nodes: capacity, weight, budget (of the parent).
    """
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(1))  # a row for each node, after aggregation
    full = by.orderBy(F.col("capacity") / F.col("weight"), *LEVELS[: len(parent) + 1]).rowsBetween(W.unboundedPreceding, -1)
    # in order of capacity / weight, a node is full if the level it would need is at most what is left for it and those behind it
    before_c, before_w = F.coalesce(F.sum("capacity").over(full), F.lit(0.0)), F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    all_ = F.sum("weight").over(by)
    at = nodes.withColumns({"_left": F.greatest(F.lit(0.0), F.col("budget") - before_c), "_w": F.greatest(all_ - before_w, F.lit(1e-12))})
    at = at.withColumn("_short", F.col("capacity") * F.col("_w") > F.col("weight") * F.col("_left") * (1 + 1e-12))
    level = F.min(F.when(F.col("_short"), F.struct((F.col("capacity") / F.col("weight")).alias("r"), (F.col("_left") / F.col("_w")).alias("level")))).over(by)["level"]
    return at.withColumn("target", F.when(F.col("_short"), F.least("capacity", F.col("weight") * level)).otherwise(F.col("capacity"))).drop("_left", "_w", "_short")


def budgets(leaves: DataFrame, weights: dict, share: float, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, target) from (domain, lang, source, tokens): the target of every leaf."""
    weight = lambda level: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in weights[level].items() for x in (k, float(v))]), F.col(level)), F.lit(float(weights[level]["*"])))
    top = leaves.agg((F.sum("tokens") * F.lit(float(share))).cast("double").alias("budget"))  # one row
    cap = (F.sum("tokens") * F.lit(epochs)).cast("double").alias("capacity")
    at = shared_out(leaves.groupBy("domain").agg(cap).crossJoin(F.broadcast(top)).withColumn("budget", F.least("budget", F.sum("capacity").over(W.partitionBy(F.lit(1))))).withColumn("weight", weight("domain")), [])
    for i in (1, 2):
        up = at.select(*LEVELS[:i], F.col("target").alias("budget"))
        at = shared_out(leaves.groupBy(*LEVELS[: i + 1]).agg(cap).join(up.hint("merge"), LEVELS[:i]).withColumn("weight", weight(LEVELS[i])), LEVELS[:i])
    return leaves.join(at.select(*LEVELS, "target").hint("merge"), LEVELS)


def mix(docs: DataFrame, weights: dict | None = None, share: float = 0.6, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, digits: int = 3) -> DataFrame:
    """Which documents to take, and how often, so that the tokens of the leaves come near their targets.

    One row per taken document: doc_id, domain, lang, source, tokens, copies, text_hash. The budget is share of all tokens
    (words, unless tokens is given); a leaf may be used up to epochs times. A leaf takes all its documents once for each
    whole epoch in its target, and of the next epoch the documents in the order of md5(seed:epoch:doc_id:text_hash), then
    tokens, until the target is reached, the last one included. text_hash is the XXH64 of the text. Null languages and sources
    are named "?"; null text has no tokens, and a document without tokens is taken when the prefix passes it; a null identifier
    counts as empty text in the hash. Rows that repeat identifier, text and leaf are one document of that many rows, whose copies
    count them all. An empty table gives an empty result; other columns are ignored.

    A leaf may hold a third of all rows: its order is cut into 16^digits ranges whose sums are made before the shuffle,
    and only the one range in which the target falls is summed up row by row.
    """
    weights = weights or WEIGHTS
    name = lambda c: F.coalesce(F.col(c), F.lit("?"))
    count = (F.size(words(F.col(text_col))) if tokens is None else tokens).cast("long")
    each = docs.select(F.col(id_col).alias("doc_id"), domain_of(F.col("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), count.alias("each"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = materialize(each.groupBy("doc_id", *LEVELS, "each", "text_hash").agg(F.count(F.lit(1)).alias("n")).withColumn("tokens", F.col("each") * F.col("n")), "tokens")
    leaves = materialize(budgets(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, share, epochs), "leaves")
    whole = F.when(F.col("leaf") > 0, F.floor(F.col("target") / F.col("leaf"))).otherwise(F.lit(0)).cast("int")
    plan = leaves.select(*LEVELS, F.col("tokens").alias("leaf"), "target").withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("leaf"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(16)).cast("int"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash").cast("string")).cast("binary"))
    named = materialize(salted.join(plan.select(*LEVELS, "whole", "rest", salts).hint("merge"), [*LEVELS, "salt"]).withColumn("order", order).withColumn("range", F.substring("order", 1, digits)).drop("salt"), "ordered")
    ranges = materialize(ranges_of(named), "ranges")
    parts = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(4)).cast("int")
    joined = named.withColumn("part", parts).join(ranges.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3)))).hint("merge"), [*LEVELS, "range", "part"])
    joined = materialize(joined, "ranged")
    edge = joined.where("some and not all")
    upto = W.partitionBy(*LEVELS, "range").orderBy("order", "each").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("tokens").over(upto), F.lit(0))
    # of the rows of one document, those that begin before the target
    some = F.when(left <= 0, F.lit(0)).when(F.col("each") > 0, F.least(F.col("n"), F.ceil(left / F.col("each")))).otherwise(F.col("n"))
    out = joined.where("not some or all").withColumn("extra", F.when(F.col("all"), F.col("n")).otherwise(F.lit(0))).unionByName(edge.withColumn("extra", some))
    copies = (F.col("whole") * F.col("n") + F.col("extra")).cast("long")
    return out.withColumn("copies", copies).where("copies > 0").select("doc_id", *LEVELS, F.col("each").alias("tokens"), "copies", "text_hash")


def ranges_of(named: DataFrame) -> DataFrame:
    """(leaf, range, before, all, some): the tokens before each range, and whether all or some of it lies before the target.

    Sums over first digits come first, so no window has all ranges of a leaf.
    """
    ranges = named.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest")).withColumn("digit", F.substring("range", 1, 1))
    upto = lambda by: F.coalesce(F.sum("sum").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    digits = ranges.groupBy(*LEVELS, "digit").agg(F.sum("sum").alias("sum")).select(*LEVELS, "digit", upto(W.partitionBy(*LEVELS).orderBy("digit")).alias("first"))
    placed = ranges.withColumn("before", upto(W.partitionBy(*LEVELS, "digit").orderBy("range"))).join(digits.hint("merge"), [*LEVELS, "digit"])
    before = F.col("before") + F.col("first")
    return placed.select(*LEVELS, "range", before.alias("before"), ((before < F.col("rest")) & (before + F.col("sum") <= F.col("rest"))).alias("all"), (before < F.col("rest")).alias("some"))
