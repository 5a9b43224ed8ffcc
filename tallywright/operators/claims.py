"""Claims: planted changes of meaning, and what a written answer must and must not say."""

from __future__ import annotations

import difflib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.sources.files import written

#: The directions of labels, and words that claims are changed by. Fixed values.
DIRECTIONS = {"consistent": "supports", "inconsistent": "contradicts", "no_clear_difference": "inconclusive", "unavailable": "unavailable"}
TURNED = [("more often", "less often"), ("More than half", "Fewer than half"), ("more than half", "fewer than half")]
CAUSE, LIMITS = " This is because they differ in what they read.", "(?i)\\brestrict|\\bonly among|\\bamong people"
#: Classes of characters whose counts bound a likeness.
LETTERS = 64
#: What only has to be left out, so that there is nothing to quote.
ABSENT = ("E5_no_verdict", "E7_suppression")


def swapped(text: Column, a: Column, b: Column) -> Column:
    """text with a for b and b for a."""
    return F.replace(F.replace(F.replace(text, a, F.lit("\x01")), b, a), F.lit("\x01"), b)


def planted(claim: Column, a: Column, b: Column, labels: Column, parts: Column, causal: Column, population: Column, seed: Column) -> dict[str, Column]:
    """A changed claim of each of seven kinds; null where the kind can't be planted.

    a, b: the compared groups; labels: the measures of the catalogue, sorted; parts: how many parts and gaps the claim has; causal and
    population: whether it has a causal clause and a population; seed: a number that chooses the other measure.
    """
    differs = lambda x: F.when(x != claim, x)
    flipped = reduce(lambda t, p: swapped(t, F.lit(p[0]), F.lit(p[1])), TURNED, claim)
    halves = F.split(claim, "\\bhalf\\b", 2)
    said = F.filter(F.split(F.regexp_replace(F.trim(claim), "([.?!])\\s+", "$1\n"), "\n"), lambda x: x != "")
    kept = F.array_join(F.filter(said, lambda x: ~x.rlike(LIMITS)), " ")
    measure = F.get(F.filter(F.regexp_extract_all(claim, F.lit("'([^']+)'"), F.lit(1)), lambda x: F.array_contains(labels, x)), F.lit(0))
    others = F.filter(labels, lambda x: x != measure)
    other = F.get(others, F.pmod(seed, F.greatest(F.size(others), F.lit(1))).cast("int"))
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    at = F.instr(claim, quoted(measure))
    return {
        "flip_direction": differs(flipped),
        "swap_groups": F.when(F.contains(claim, a) & F.contains(claim, b), swapped(claim, a, b)),
        "change_threshold": F.when(F.size(halves) == 2, F.concat(halves[0], F.lit("a third"), F.get(halves, F.lit(1)))),
        "drop_part": F.when((F.size(said) > 1) & (parts > 1), F.array_join(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), " ")),
        "add_causal": F.when(~causal, F.concat(F.rtrim(claim), F.lit(CAUSE))),
        "drop_population": F.when(population & (kept != F.trim(claim)), kept),
        "swap_measure": F.when(measure.isNotNull() & (F.size(others) > 0), F.concat(F.substring(claim, F.lit(1), at - 1), quoted(other), F.substring(claim, at + F.length(measure) + 2, F.length(claim)))),
    }


def expectations(findings: DataFrame, gaps: DataFrame, hidden: DataFrame, causal: bool) -> DataFrame:
    """(item, type, critical, quote_required): what a reader checks in an answer, by the evidence of one pack.

    findings: (id, label, label_holm); gaps: (id, kind) of not_measured and proxy_variable; hidden: (id, grp) of suppressed groups.
    A finding is to be cited in its direction (E1) or as inconclusive (E2), and qualified where Holm changes its label (E9); an
    unavailable one is to be named so (E11); gaps (E3), proxies (E4), hidden values (E7), no verdict (E5), no cause (E6), scope
    (E8) and, with a contradiction, balance (E10).
    """
    direction = F.element_at(F.create_map(*[F.lit(x) for p in DIRECTIONS.items() for x in p]), F.col("label"))
    item = lambda kind, critical, when, name=F.col("id"): F.when(when, F.struct(F.concat(F.lit(kind.split("_")[0] + ":"), name).alias("item"), F.lit(kind).alias("type"), F.lit(critical).alias("critical")))
    sided = direction.isin("supports", "contradicts")
    per = F.array(item("E1_direction", True, sided), item("E9_adjustment", False, sided & ~F.col("label_holm").eqNullSafe(F.col("label"))), item("E2_inconclusive", True, direction == "inconclusive"), item("E11_unavailable", True, direction == "unavailable"))
    rows = lambda df, items: df.select(F.inline(F.filter(items, lambda x: x.isNotNull())))
    out = rows(findings, per)
    out = out.unionByName(rows(gaps, F.array(item("E3_gap", True, F.col("kind") == "not_measured"), item("E4_proxy", False, F.col("kind") == "proxy_variable"))))
    out = out.unionByName(rows(hidden, F.array(item("E7_suppression", True, F.lit(True), F.concat_ws(":", "id", "grp")))))
    whole = lambda kind, critical, when=F.lit(True): F.when(when, F.struct(F.lit(kind.split("_")[0]).alias("item"), F.lit(kind).alias("type"), F.lit(critical).alias("critical")))
    all_ = findings.agg(F.coalesce(F.bool_or(direction == "contradicts"), F.lit(False)).alias("against"))  # one row
    out = out.unionByName(rows(all_, F.array(whole("E5_no_verdict", True), whole("E6_no_causal", True, F.lit(causal)), whole("E8_scope", False), whole("E10_balance", False, F.col("against")))))
    return out.withColumn("quote_required", ~F.col("type").isin(*ABSENT))


def likeness(ask: str, text: str) -> float:
    """1 where a text contains what is asked for, else the ratio of matching blocks; both are folded."""
    return 1.0 if ask in text else difflib.SequenceMatcher(None, ask, text).ratio()


def letters(texts: list[str]) -> np.ndarray:
    """How often each text has a character, for each of LETTERS classes of characters."""
    out = np.zeros((len(texts), LETTERS), dtype="int32")
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype="<u4") % LETTERS, minlength=LETTERS)
    return out


def best_of_block(asks: list[str], texts: list[str], cards: list[list], k: int, least: float) -> list[tuple]:
    """(ask, id, ordinal, score) of the k cards that are most like each query, of those of the texts.

    Matching blocks are characters of both, so their share is at most that of the characters that both have. Texts are scored from
    the greatest such bound down, until it is below `least` or the k-th best card so far.
    """
    folded, named = [t.casefold() for t in texts], [a.casefold() for a in asks]
    have, size = letters(folded), np.array([len(t) for t in folded])
    out = []
    for ask, x, own in zip(asks, named, letters(named), strict=True):
        common = np.minimum(have, own).sum(axis=1)
        bound = np.where(common >= len(x), 1.0, 2.0 * common / np.maximum(size + len(x), 1))
        found: dict = {}
        kth = least
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < kth:
                break
            score = likeness(x, folded[i])
            if score < kth:
                continue
            for ordinal, card in cards[i]:
                found[ordinal, card] = max(found.get((ordinal, card), 0.0), score)
            if len(found) >= k:
                kth = max(least, sorted(found.values(), reverse=True)[k - 1])
        out += [(ask, card, ordinal, score) for (ordinal, card), score in sorted(found.items(), key=lambda f: (-f[1], f[0][0]))[:k]]
    return out


def find_variables(asks: DataFrame, cards: DataFrame, k: int = 10, least: float = 0.3, section: str | None = None, block: int = 2000) -> DataFrame:
    """(ask, id, score, place): the k cards most like each query, by the best of their texts; catalogue order breaks ties.

    asks: (ask); cards: (id, ordinal, label, block, values, section), of the section, or all. Null queries and texts are passed over.
    Equal texts are scored once, for the k first cards that have them. Queries and texts are dealt into blocks, and each pair of blocks is one
    task's work: the bound on the score leaves few texts of a block to be scored. (At a least score of 0.3 an index of characters or
    q-grams would list nearly every text.)
    """
    from pyspark.sql import Window as W

    if k < 1:
        raise ValueError("WrongSearch: k must be a positive whole number")
    held = cards.where(F.col("section") == section) if section is not None else cards
    texts = held.select("id", "ordinal", F.explode(F.array_distinct(F.concat(F.array("id", "label", "block"), F.coalesce("values", F.array().cast("array<string>"))))).alias("text")).where("text is not null").distinct()
    first = texts.withColumn("nth", F.row_number().over(W.partitionBy("text").orderBy("ordinal", "id"))).where(F.col("nth") <= k)
    lists = written(first.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("cards")))  # k cards at most
    asked = written(asks.select("ask").where("ask is not null").distinct())
    rows, columns = (max(1, -(-df.count() // block)) for df in (asked, lists))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("i", place("ask", rows)).withColumn("j", every(columns))
    right = lists.withColumn("j", place("text", columns)).withColumn("i", every(rows))

    def best(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found = best_of_block(a["ask"].tolist(), t["text"].tolist(), [[(c["ordinal"], c["id"]) for c in x] for x in t["cards"]], k, least)
        return pd.DataFrame(found, columns=["ask", "id", "ordinal", "score"])

    kinds = dict(cards.dtypes)
    scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, f"ask string, id {kinds['id']}, ordinal {kinds['ordinal']}, score double")
    each = scored.groupBy("ask", "id", "ordinal").agg(F.max("score").alias("score"))
    return each.withColumn("place", F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "ordinal"))).where(F.col("place") <= k).select("ask", "id", "score", "place")


def meaning_checks(claims: DataFrame, parts: DataFrame, gaps: DataFrame, proxies: DataFrame) -> DataFrame:
    """(claim_id, item, statement, quote_required): what a paraphrase of each claim must keep, part by part.

    claims: (claim_id, causal); parts: (claim_id, place, measure, kind, a, b, direction, population), kind threshold (of a alone) or difference; gaps: (claim_id, place, concept);
    proxies: (claim_id, place, concept, variables). A part gives its measure, its groups, its direction, and its population if it has one; each gap and proxy is kept as it was said;
    a cause is kept or must be absent; and nothing is added. What has to be absent needs no quote.
    """
    item = lambda name, statement, quote=True: F.struct(name.alias("item"), statement.alias("statement"), F.lit(quote).alias("quote_required"))
    at = lambda kind, name: F.concat(F.lit(kind), F.col("place").cast("string"), F.lit(name))
    say = lambda *words: F.concat(*[F.lit(w) if w.startswith(" ") or w.endswith(" ") or w.endswith(".") else F.col(w) for w in words])
    threshold = F.col("kind") == "threshold"
    of_part = F.array(
        item(at("P", "_measure"), say("The part measures: ", "measure", ".")),
        item(at("P", "_groups"), F.when(threshold, say("It is about ", "a", ".")).otherwise(say("It compares ", "a", " with ", "b", "."))),
        item(at("P", "_direction"), F.when(threshold, say("It says ", "direction", " half of them.")).otherwise(say("It says that ", "a", " do it ", "direction", " ", "b", "."))),
        F.when(F.coalesce("population", F.lit("")) != "", item(at("P", "_population"), say("It is only about ", "population", "."))),
    )
    rows = lambda df, items: df.select("claim_id", F.inline(F.filter(items, lambda x: x.isNotNull())))
    out = rows(parts, of_part)
    out = out.unionByName(rows(gaps, F.array(item(at("G", ""), say("What is said of ", "concept", " stays as it is said.")))))
    out = out.unionByName(rows(proxies, F.array(item(at("X", ""), F.concat(F.array_join("variables", ", "), F.lit(" stand for "), F.col("concept"), F.lit("."))))))
    causal = F.coalesce("causal", F.lit(False))
    whole = F.array(F.when(causal, item(F.lit("W_causal"), F.lit("The cause is kept as it is said."))).otherwise(item(F.lit("W_causal"), F.lit("No cause is named."), False)), item(F.lit("W_extra"), F.lit("Nothing is added."), False))
    return out.unionByName(rows(claims, whole))


def numerical_requirements(results: DataFrame, estimates: DataFrame, wanted: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, id, kind, groups): the results of a case whose numbers an answer has to give.

    results: (case_id, id, kind, variable, operation), of which estimates and contrasts count; estimates: (case_id, id, grp, n, value); wanted: (case_id, grp), the groups that a case asks for, no row meaning
    all; cases: (case_id, asked), whether numbers are asked for at all. An estimate keeps the groups that are wanted, in order, and goes without any; a contrast stands by itself (groups null).
    """
    open_ = results.join(cases.where("asked").select("case_id").hint("merge"), "case_id", "left_semi")
    picky = wanted.select("case_id").distinct().withColumn("picky", F.lit(True))
    rows = estimates.join(picky.hint("merge"), "case_id", "left").join(wanted.distinct().withColumn("hit", F.lit(True)).hint("merge"), ["case_id", "grp"], "left").where("picky is null or hit")
    kept = rows.groupBy("case_id", "id").agg(F.array_sort(F.collect_set("grp")).alias("groups"))  # the groups of an estimate
    found = open_.where("kind = 'estimate'").join(kept.hint("merge"), ["case_id", "id"]).select("case_id", "id", "kind", "groups")
    return found.unionByName(open_.where("kind = 'contrast'").select("case_id", "id", "kind", F.lit(None).cast("array<string>").alias("groups")))
