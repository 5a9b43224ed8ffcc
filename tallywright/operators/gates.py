"""Gates: what must hold before results count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.sources.files import written

from .contrasts import compare


def scope_faults(gate: DataFrame, records: DataFrame) -> DataFrame:
    """(scope, error): whether a gate (scope, record_id, version) was made on exactly these records and versions.

    Each side is summed up to a count and two order-free fingerprints, so no record is joined.
    """
    mark = lambda df, side: df.groupBy("scope").agg(F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("record_id")), F.sum(F.xxhash64("record_id", F.lit(1)).cast("decimal(38,0)"))).alias(f"{side}_ids"), F.array_sort(F.collect_set("version")).alias(f"{side}_versions"))  # noqa: E731  a few versions
    both = mark(records, "own").join(mark(gate, "gate").hint("merge"), "scope", "full_outer")
    error = F.when(~F.col("own_ids").eqNullSafe(F.col("gate_ids")), "OtherRecords").when(~F.col("own_versions").eqNullSafe(F.col("gate_versions")), "OtherVersion").otherwise("")
    return both.select("scope", error.alias("error"))


def response_rates(rows: DataFrame, by: str) -> DataFrame:
    """Rates of responses (output, ended): text at all, and text that ended within the budget; failures stay in the denominator."""
    some, n = F.coalesce(F.col("output") != "", F.lit(False)), F.count(F.lit(1))
    each = rows.groupBy(by).agg(n.alias("examples"), F.count_if(some).alias("some"), F.count_if(some & F.col("ended")).alias("whole"), F.count_if(some & ~F.col("ended")).alias("truncated"), F.count_if(~some).alias("empty_output"))
    return each.select(by, "examples", (F.col("some") / F.col("examples")).alias("nonempty_response_rate"), (F.col("whole") / F.col("examples")).alias("generated_output_rate"), "truncated", "empty_output")


def older_contracts(counted: DataFrame, skip: str | None = None) -> DataFrame:
    """(a, b, matched): for each required "a is higher than b" of groups that are named by their value, whether the contrasts say so.

    counted: (grp, n, k). skip: a group whose first place is declared under another value, so no contrast can match it.
    """
    found = compare(counted).select("a", "b", F.signum("value").alias("sign"))
    either = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("sign")).alias("sign")))
    named = F.when(F.col("a") == skip, F.lit(None)).otherwise(F.col("a")) if skip else F.col("a")
    return either.select("a", "b", F.coalesce(named.isNotNull() & (F.col("sign") > 0), F.lit(False)).alias("matched"))


def verifier_gate(jobs: DataFrame, calls: DataFrame, verdicts: DataFrame, needs: dict[str, float], kinds: list[str]) -> DataFrame:
    """(measure, n, hits, rate, need, met): whether a verifier may be relied on, from its verdicts on claims that are untouched or changed.

    jobs: (id, record_id, kind, run), kind "original" or a kind of change; calls: (id, error), the latest call of each job last by its row
    is enough, an error being text; verdicts: (id, item, passed), a row for each item of a checklist. A claim is accepted if its call has no error and
    it has items and all passed. acceptance: first runs of originals; self_agreement: items of an original that both runs have, judged alike;
    rejection of each kind; calls: jobs that have one without an error, all of which must. needs: acceptance, self_agreement, rejection. A kind without a job is untested and fails nothing (met is null); "gate" is
    met if all others are.
    """
    # a checklist; with that, a job is one row, written once for all measures
    each = verdicts.groupBy("id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("all_passed"), F.collect_list(F.struct("item", "passed")).alias("items"))
    called = calls.groupBy("id").agg(F.bool_or(F.coalesce("error", F.lit("")) != "").alias("failed"))
    judged = jobs.join(called.hint("merge"), "id", "left").join(each.hint("merge"), "id", "left")
    judged = judged.withColumns({"answered": ~F.coalesce("failed", F.lit(True)), "accepted": ~F.coalesce("failed", F.lit(True)) & F.coalesce("all_passed", F.lit(False))})
    judged = written(judged.select("record_id", "kind", "run", "answered", "accepted", F.when((F.col("kind") == "original") & F.col("answered"), F.col("items")).alias("items")), "judged")
    original = F.col("kind") == "original"
    row = lambda name, n, hits, need: F.struct(F.lit(name).alias("measure"), n.alias("n"), hits.alias("hits"), F.lit(float(need)).alias("need"))
    sums = judged.agg(
        F.array(
            row("calls", F.count(F.lit(1)), F.count_if("answered"), 1.0),
            row("acceptance", F.count_if(original & (F.col("run") == 1)), F.count_if(original & (F.col("run") == 1) & F.col("accepted")), needs["acceptance"]),
            *[row(f"rejection:{k}", F.count_if(F.col("kind") == k), F.count_if((F.col("kind") == k) & ~F.col("accepted")), needs["rejection"]) for k in kinds],
        ).alias("rows")
    ).select(F.inline("rows"))
    items = judged.where("items is not null").select("record_id", "run", F.inline("items"))
    twice = items.groupBy("record_id", "item").agg(F.max(F.when(F.col("run") == 1, F.col("passed").cast("int"))).alias("a"), F.max(F.when(F.col("run") == 2, F.col("passed").cast("int"))).alias("b")).where("a is not null and b is not null")
    agree = twice.agg(row("self_agreement", F.count(F.lit(1)), F.count_if(F.col("a") == F.col("b")), needs["self_agreement"]).alias("x")).select("x.*")
    rates = sums.unionByName(agree).withColumn("rate", F.col("hits") / F.nullif("n", F.lit(0)))
    tested = F.when(F.startswith("measure", F.lit("rejection:")) & (F.col("n") == 0), F.lit(None)).otherwise(F.coalesce(F.col("rate") >= F.col("need"), F.lit(False)))
    rates = rates.withColumn("met", tested.cast("boolean"))
    whole = rates.agg(F.lit("gate").alias("measure"), F.count("met").alias("n"), F.count_if("met").alias("hits"), F.lit(1.0).alias("need"))
    whole = whole.withColumn("rate", F.col("hits") / F.nullif("n", F.lit(0))).withColumn("met", F.col("n") == F.col("hits"))
    return rates.unionByName(whole).select("measure", "n", "hits", "rate", "need", "met")
