"""Runs analyses that are given as rows of a table: one scan for all estimates, tests on their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.stats import EXPECTED, SUPPRESS, contrast_label
from tallywright.sources.files import written

from . import contrasts, estimates
from .claims import find_variables
from .filters import Filter, Study

COLUMNS = "spec_id string, op string, variable string, grp string, other string, n long, value double, p double, label string, error string"
#: Operations on respondents, on the counts of another spec, on pairs of variables, and notes without a number.
#: Describe counts answers like an estimate; values and find_variables look at the catalogue.
ESTIMATES, TESTS, PAIRS, NOTES = ("share", "top_box", "mean", "sizes", "distribution", "rank", "describe"), ("compare", "threshold", "trend"), ("association", "adjusted"), ("subclaim", "gap", "proxy", "caveat")
#: What is expected of a trend, in the signs of other tests.
DIRECTIONS = {"increasing": ">", "decreasing": "<", "any": "!="}


def expanded(study: Study, spec: dict) -> list[tuple[str | None, Column, Column]]:
    """(other, base, score) for each row of a spec and group: who counts, and the number whose mean is the value (null: none)."""
    op, v = spec["op"], spec["variable"]
    if op == "rank":
        return [(c, study.base(c), F.coalesce(F.col(c), F.lit(False)).cast("double")) for c in study.blocks[v]]
    if v not in study.values and v not in study.block_of:
        raise ValueError(f"UnknownVariable: {v}")
    if op == "describe":
        return [("recorded", F.col(v).isNotNull(), F.lit(None).cast("double")), ("observed", study.base(v), F.lit(None).cast("double"))]
    if op == "share":
        f = study.where(v, [spec.get("value", True)])
        return [(None, f.universe, f.mask.cast("double"))]
    if op == "distribution":
        return [(x, study.base(v), (F.col(v) == x).cast("double")) for x in study.values[v]]
    if op == "sizes":
        return [(None, study.base(v), F.lit(None).cast("double"))]
    if v not in study.scales:
        raise ValueError(f"WrongAnswerType: {v} has no order")
    best = F.col(v).isin(study.scales[v][-spec.get("value", 2) :]).cast("double") if op == "top_box" else estimates.score(study, v).cast("double")
    return [(None, study.ordered_base(v), best)]


def groups_of(study: Study, spec: dict) -> dict[str, Filter]:
    by = spec.get("by")
    if by is None:
        return {estimates.ALL: Filter(F.lit(True), F.lit(True))}
    if by not in study.values:
        raise ValueError(f"UnknownVariable: {by}")
    return study.groups(by)


def sums(df: DataFrame, study: Study, specs: list[dict]) -> tuple[DataFrame | None, dict[str, str]]:
    """(spec_id, grp, other, n, s, ss) of all estimate specs from one scan, written as it is small; and the errors by spec."""
    aggs, rows, errors = [], [], {}
    for spec in specs:
        try:
            among = study.tree(spec["among"]).mask if spec.get("among") else F.lit(True)
            each = [(g, other, F.coalesce(base, F.lit(False)) & f.mask & among, y) for g, f in groups_of(study, spec).items() for other, base, y in expanded(study, spec)]
        except (ValueError, KeyError) as e:
            errors[spec["spec_id"]] = str(e).strip("'").split(":")[0] if isinstance(e, ValueError) else "UnknownVariable"
            continue
        for g, other, inside, y in each:
            i = len(rows)
            aggs += [F.count_if(inside).alias(f"n{i}"), F.sum(F.when(inside, y)).alias(f"s{i}"), F.sum(F.when(inside, y * y)).alias(f"q{i}")]
            rows.append(F.struct(F.lit(spec["spec_id"]).alias("spec_id"), F.lit(g).alias("grp"), F.lit(other).cast("string").alias("other"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("ss")))
    if not rows:
        return None, errors
    return written(df.agg(*aggs).select(F.inline(F.array(*rows))), "sums"), errors


def results(df: DataFrame, kind: str | Column, **given: Column) -> DataFrame:
    """df in the columns of results; spec_id is of df, and what isn't given is null."""
    known = {"spec_id": F.col("spec_id"), "op": F.lit(kind) if isinstance(kind, str) else kind, "error": F.lit("")} | given
    return df.select(*[(known[name] if name in known else F.lit(None)).cast(t).alias(name) for name, t in (c.split() for c in COLUMNS.split(", "))])


def problem(spec: dict, known: dict[str, dict], errors: dict[str, str], study: Study) -> str:
    """The code of why a spec can't be run; empty if it can."""
    op, of = spec["op"], known.get(spec.get("of"))
    if op == "caveat" and len(spec["text"]) > 200:
        return "CaveatTooLong"
    if op in NOTES:
        return ""
    if op in ESTIMATES:
        return errors.get(spec["spec_id"], "")
    if op == "values":
        return "" if spec["variable"] in study.values or spec["variable"] in study.block_of else "UnknownVariable"
    if op == "find_variables":
        return "" if isinstance(spec.get("k", 10), int) and spec.get("k", 10) >= 1 and isinstance(spec.get("text"), str) else "WrongSearch"
    if op not in TESTS + PAIRS:
        return "UnknownOperation"
    if op in TESTS and (of is None or of["op"] not in ESTIMATES or of["spec_id"] in errors):
        return "UnknownEstimate"
    if op in ("compare", "threshold"):
        if of["op"] not in ("share", "top_box"):
            return "WrongAnswerType"
        if op == "threshold" and not 0 < spec["value"] < 1:
            return "WrongThreshold"
    if op != "association" and spec.get("expect") not in ((*DIRECTIONS, None) if op == "trend" else (*EXPECTED, None)):
        return "WrongExpectation"
    if op in PAIRS:
        own = [spec["variable"], spec["by"], *spec.get("controls", [])]
        if any(v not in study.values and v not in study.block_of for v in own):
            return "UnknownVariable"
        if op == "adjusted":
            if spec["variable"] in spec["controls"]:
                return "WrongControls"
            try:
                study.where(spec["variable"], [spec["value"]])
                groups = study.groups(spec["by"])
            except ValueError as e:
                return str(e).split(":")[0]
            return "" if {spec["a"], spec["b"]} <= groups.keys() else "UnknownGroup"
    return ""


def cells_of(df: DataFrame, study: Study, specs: list[dict]) -> DataFrame:
    """(spec_id, u, v, n): the cells of all associations, and of adjusted comparisons the strata (u) and the cells a to d of each (v), from one scan."""
    rows = []
    for s in specs:
        if s["op"] == "association":
            inside, u, v = study.base(s["variable"]) & study.base(s["by"]), F.col(s["variable"]), F.col(s["by"])
        else:
            f, groups = study.where(s["variable"], [s["value"]]), study.groups(s["by"])
            a, b = groups[s["a"]].mask, groups[s["b"]].mask
            inside = f.universe & (a | b) & reduce(lambda x, y: x & y, [study.base(c) for c in s["controls"]], F.lit(True))
            u, v = F.to_json(F.struct(*s["controls"])) if s["controls"] else F.lit(""), F.when(a, F.when(f.mask, "a").otherwise("b")).otherwise(F.when(f.mask, "c").otherwise("d"))
        rows.append(F.when(inside, F.struct(F.lit(s["spec_id"]).alias("spec_id"), u.cast("string").alias("u"), v.cast("string").alias("v"))))
    return written(df.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))).groupBy("spec_id", "u", "v").agg(F.count(F.lit(1)).alias("n")), "cells")


def run_specs(df: DataFrame, study: Study, specs: list[dict]) -> DataFrame:
    """One row (COLUMNS) for each spec, group and option.

    A spec has spec_id and op. Estimates (share, top_box, mean, sizes, distribution, rank) have variable (for rank, a block), value,
    by and among (a filter tree); compare (a, b, expect), threshold (value, expect) and trend (order, expect) are of another
    spec; association (variable, by) and adjusted (variable, value, by, a, b, controls, expect) look at respondents; notes
    (subclaim, gap, proxy, caveat) have a text, which becomes the label. describe (variable) gives how many answers are recorded and how many observed,
    values (variable) the stored answers in their order, find_variables (text, k) the variables most like a text, with score and place. A spec that can't be run is one row with
    its error; the others still run. Bases under ten have no value.

    The columns that the specs name are written once, and two scans give the sums of all estimates and the cells of all associations and
    adjusted comparisons. Each kind of operation is then one expression over the rows of all its specs, so neither scans nor plan grow with the number of specs.
    """
    spark = df.sparkSession
    known = {s["spec_id"]: s for s in specs}
    df = written(df.select(*[c for c in df.columns if c in study.values or c in study.block_of]), "answers")
    counted, errors = sums(df, study, [s for s in specs if s["op"] in ESTIMATES])
    wrong = {s["spec_id"]: problem(s, known, errors, study) for s in specs}
    runs = lambda *ops: [s for s in specs if s["op"] in ops and not wrong[s["spec_id"]]]
    plain = [(s["spec_id"], s["op"], s.get("variable"), None, None, None, None, None, s["text"] if s["op"] in NOTES and not wrong[s["spec_id"]] else None, wrong[s["spec_id"]]) for s in specs if wrong[s["spec_id"]] or s["op"] in NOTES]
    for s in runs("values"):
        v = s["variable"]
        stored = ["true", "false"] if v in study.block_of else [*study.scales.get(v, []), *[x for x in study.values[v] if x not in study.scales.get(v, [])]]
        plain += [(s["spec_id"], "values", v, None, x, i, None, None, None, "") for i, x in enumerate(stored, 1)]
    out = [spark.createDataFrame(plain, COLUMNS)] if plain else []
    if counted is not None:
        which = spark.createDataFrame([(s["spec_id"], s["op"], s["variable"]) for s in runs(*ESTIMATES)], "spec_id string, op string, variable string")
        value = F.when(F.col("n") >= SUPPRESS, F.col("s") / F.nullif(F.col("n"), F.lit(0)))
        out.append(results(counted.join(which.hint("broadcast"), "spec_id"), F.col("op"), variable=F.col("variable"), grp=F.col("grp"), other=F.col("other"), n=F.col("n"), value=value))
    if tests := runs(*TESTS):
        rows = [(s["spec_id"], s["op"], s["of"], DIRECTIONS.get(s.get("expect")) if s["op"] == "trend" else s.get("expect"), float(s.get("value") or 0), s.get("order")) for s in tests]
        asked = spark.createDataFrame(rows, "spec_id string, op string, of string, expect string, threshold double, order array<string>")
        mine = written(counted.withColumnRenamed("spec_id", "of").join(asked.hint("broadcast"), "of").withColumn("k", F.coalesce("s", F.lit(0.0)).cast("long")), "tested")  # a row for each spec
        number = {"n": F.col("n"), "value": F.col("value"), "p": F.col("p"), "label": F.col("label")}
        if runs("compare"):
            found = contrasts.compare(mine.where("op = 'compare'"), F.col("expect"), ["spec_id", "expect"])
            out.append(results(found, "compare", **number | {"grp": F.col("a"), "other": F.col("b"), "n": F.col("na") + F.col("nb")}))
        if runs("threshold"):
            out.append(results(contrasts.against(mine.where("op = 'threshold'"), F.col("threshold"), F.col("expect")), "threshold", **number | {"grp": F.col("grp")}))
        if runs("trend"):
            place = F.array_position("order", F.col("grp"))
            each = mine.where("op = 'trend'").withColumn("position", place - 1).where("position >= 0").select("spec_id", "expect", "position", "n", "s", "ss")
            found = contrasts.trend(each, ["spec_id", "expect"])
            out.append(results(found, "trend", **number | {"value": F.col("slope"), "label": contrast_label(F.col("lo"), F.col("hi"), F.col("expect"))}))
    if pairs := runs(*PAIRS):
        cells = cells_of(df, study, pairs)
        named = spark.createDataFrame([(s["spec_id"], s["op"], s["variable"], s["by"], s.get("a"), s.get("b"), s.get("expect")) for s in pairs], "spec_id string, op string, variable string, other string, a string, b string, expect string")
        cells = cells.join(named.select("spec_id", "op").hint("broadcast"), "spec_id")  # a row for each spec
        if runs("association"):
            found = contrasts.associations(cells.where("op = 'association'").select(F.col("spec_id").alias("x"), F.lit("").alias("y"), "u", "v", F.col("n").alias("k"))).withColumnRenamed("x", "spec_id").withColumnRenamed("v", "cramer")
            out.append(results(found.join(named.hint("broadcast"), "spec_id"), "association", variable=F.col("variable"), other=F.col("other"), n=F.col("n"), value=F.col("cramer"), p=F.col("p")))
        if runs("adjusted"):
            strata = cells.where("op = 'adjusted'").groupBy("spec_id", "u").agg(*[F.coalesce(F.sum(F.when(F.col("v") == x, F.col("n"))), F.lit(0)).alias(x) for x in "abcd"])
            strata = strata.join(named.select("spec_id", "expect").hint("broadcast"), "spec_id")
            found = contrasts.mantel_haenszel(strata, F.col("expect"), ["spec_id", "expect"]).join(named.drop("expect").hint("broadcast"), "spec_id")
            out.append(results(found, "adjusted", variable=F.col("variable"), grp=F.col("a"), other=F.col("b"), n=F.col("strata"), value=F.col("odds_ratio"), p=F.col("p"), label=F.col("label")))
    if looked := runs("find_variables"):
        cards = spark.createDataFrame([(v, i, v, study.block_of.get(v, v), list(study.values.get(v, ["true", "false"])), None) for i, v in enumerate([*study.values, *study.block_of])], "id string, ordinal int, label string, block string, values array<string>, section string")
        asks = spark.createDataFrame([(s["spec_id"], s["text"], s.get("k", 10)) for s in looked], "spec_id string, ask string, k int")
        found = find_variables(asks, cards, max(s.get("k", 10) for s in looked)).join(asks.hint("broadcast"), "ask").where("place <= k")
        out.append(results(found, "find_variables", other=F.col("id"), n=F.col("place"), value=F.col("score")))
    return reduce(DataFrame.unionByName, out)
