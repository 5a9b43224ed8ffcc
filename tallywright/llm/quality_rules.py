"""Quality rules with thresholds that adapt to each language and source (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bind, materialize, words

#: Characters counted as symbols, and the window of the repetition rule. Fixed values of the query contract.
SYMBOLS, WINDOW = "[#*$%&|<>]", 8
#: metric -> (low quantile, high quantile, fence): what lies beyond the quantile by more than fence times its distance from the
#: median fails. The quantiles are those of the document's own language and source; no threshold is a constant.
METRICS = {"symbol_ratio": (None, 0.95, 0.0), "dup_line_ratio": (None, 0.98, 0.0), "repeat_ratio": (None, 0.98, 0.0), "mean_word_chars": (0.05, 0.95, 1.0)}
#: Relative error of a sketched quantile, and the bin of zero.
ERROR, ZERO = 0.01, -(1 << 30)
GAMMA = (1 + ERROR) / (1 - ERROR)


def repeated_words(array: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that the text has twice or more."""

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        spans = F.transform(starts, lambda p, i: F.when(i < last, F.least(F.lit(window), F.get(starts, i + 1) - p)).otherwise(F.lit(window)))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def again(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda z: F.filter(z, lambda x, i: F.coalesce(F.get(z, i + 1)["h"] == x["h"], F.lit(False)) | (F.coalesce(F.get(z, i - 1)["h"] == x["h"], F.lit(False))))
        starts = bind(pairs, lambda z: F.array_sort(F.transform(twice(z), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(starts, covered))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(bind(hashes, again))

    return bind(array, of)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts of the base rules and the metrics of METRICS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    counts = F.struct(
        bind(words(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col("lang"), F.col("source"), counts.alias("c"))
        .select("doc_id", "lang", "source", *[F.col(f"c.{k}").cast("long").alias(k.split(".")[-1]) for k in ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")])
        .withColumns(
            {
                "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
                "symbol_ratio": F.least(F.lit(1.0), ratio("n_symbols", "word_chars")),
                "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
                "repeat_ratio": ratio("n_repeat_words", "n_words"),
                "mean_word_chars": ratio("word_chars", "n_words"),
            }
        )
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): a quantile sketch with relative error ERROR for each language, source and metric.

    Bin i > ZERO counts the values in (GAMMA^(i-1), GAMMA^i], so a sketch has at most a few thousand bins whatever it has seen,
    and sketches merge by adding the counts of equal bins.
    """
    at = lambda m: F.when(F.col(m) > 0, F.ceil(F.log(F.col(m)) / F.lit(math.log(GAMMA)) - F.lit(1e-9))).otherwise(F.lit(ZERO)).cast("int")
    bins = F.array(*[F.struct(F.lit(m).alias("metric"), at(m).alias("bin")) for m in METRICS])
    return measured.where(~F.col("base_failed")).select("lang", "source", F.inline(bins)).groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, lo, mid, hi) of sketches merged to the keys: the least bins that reach the low quantile, the median and the high one."""
    by = W.partitionBy(*keys, "metric")
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    ranked = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(by)})
    level = lambda i: F.element_at(F.create_map(*[F.lit(x) for m, q in METRICS.items() for x in (m, float(q[i] or 0.0))]), F.col("metric"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin")))
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(level(0)).alias("lo"), at(F.lit(0.5)).alias("mid"), at(level(1)).alias("hi"))


def thresholds(sketch: DataFrame, least_group: int) -> DataFrame:
    """One row for each language and source: low and high of every metric.

    A source with fewer than least_group documents takes its language's merged sketch, and a language with fewer
    takes that of all. A threshold is the outer edge of its bin, so what lies in the bin of the quantile passes.
    """
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l2"), F.col("metric").alias("m2"), *[F.col(c).alias(f"{c}_2") for c in ("total", "lo", "mid", "hi")])
    all_ = quantiles(sketch.withColumn("any", F.lit(1)), ["any"]).select(F.col("metric").alias("m3"), *[F.col(c).alias(f"{c}_3") for c in ("lo", "mid", "hi")])
    joined = own.join(lang.hint("merge"), F.col("lang").eqNullSafe(F.col("l2")) & (F.col("metric") == F.col("m2"))).join(F.broadcast(all_), F.col("metric") == F.col("m3"))  # all_: a row for each metric
    pick = lambda q: F.when(F.col("total") >= least_group, F.col(q)).when(F.col("total_2") >= least_group, F.col(f"{q}_2")).otherwise(F.col(f"{q}_3"))
    value = lambda b, down=0: F.when(b > ZERO, F.pow(F.lit(GAMMA), b - down)).otherwise(F.lit(0.0))
    fence = F.element_at(F.create_map(*[F.lit(x) for m, q in METRICS.items() for x in (m, q[2])]), F.col("metric"))
    edges = joined.select("lang", "source", "metric", value(pick("lo"), 1).alias("lo"), value(pick("mid")).alias("mid"), value(pick("hi")).alias("hi"))
    ranges = edges.select("lang", "source", "metric", (F.col("lo") - fence * (F.col("mid") - F.col("lo"))).alias("low"), (F.col("hi") + fence * (F.col("hi") - F.col("mid"))).alias("high"))
    one = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return ranges.groupBy("lang", "source").agg(*[one(m, c) for m in METRICS for c in ("low", "high")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_group: int = 50, salts: int = 16) -> DataFrame:
    """Keeps documents whose metrics lie in the range learnt for their language and source.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, failed_rules. The thresholds are quantiles of the documents of that language and source that pass the base
    rules (see METRICS). Null or blank text has no words and fails the base rules. Null languages and sources
    are groups of their own. Repeated rows count as often as they occur and get the same verdict. An empty
    table gives an empty result; further columns are ignored.

    Documents meet their thresholds on (language, source, salt), with the few threshold rows copied for each
    salt, so a source with a third of all rows is joined by many tasks.
    """
    measured = materialize(measure(docs, id_col, text_col), "quality")
    limits = thresholds(sketches(measured), least_group).select(F.col("lang").alias("l2"), F.col("source").alias("s2"), *[f"{m}_{c}" for m in METRICS for c in ("low", "high")], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt2"))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(salts)).cast("int"))
    joined = salted.join(limits.hint("merge"), F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")) & (F.col("salt") == F.col("salt2")), "left")
    beyond = lambda m: (F.col(m) > F.col(f"{m}_high")) | ((F.col(m) < F.col(f"{m}_low")) if METRICS[m][0] else F.lit(False))
    failed = F.filter(F.array(*[F.when(beyond(m), F.lit(m)) for m in METRICS]), lambda x: x.isNotNull())
    return joined.withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules")
    )
