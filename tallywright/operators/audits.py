"""Audits of a package: each gives the rows at fault, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.sources.files import written


def split_leaks(rows: DataFrame, kinds: dict[str, str], split: str = "split") -> DataFrame:
    """(kind, key, splits) of identities that occur in more than one split."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in kinds.items()])
    return rows.select(F.inline(each), F.col(split).alias("split")).where("key is not null").groupBy("kind", "key").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def misaligned(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on one side only, or with different values."""
    joined = a.select(F.col(key), F.col(value).alias("left")).join(b.select(F.col(key), F.col(value).alias("right")), key, "full_outer")
    return joined.where(~F.col("left").eqNullSafe(F.col("right")))


def letters_from(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.substring("text", i, F.lit(n)))


def passages_in(texts: DataFrame, passages: DataFrame, words: int = 5, letters: int = 12, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, passage_id) of texts (id, text) that contain a passage (passage_id, passage), of any length.

    Where a passage of words + 2 or more words is in a text, its words but the first and last stand there whole: windows of
    the text meet by hash the passage's second to (words + 1)th word, and contains() decides. A shorter passage is met by its first
    `letters` characters (all of them if it is shorter) among the text's windows of so many characters; only lengths that occur are made. Up to broadcast_rows keys are broadcast, so that only windows that meet one are shuffled;
    beyond that, windows and keys are joined by hash. An empty passage is in every text; null texts and passages are in none.
    """
    split = passages.where(F.col("passage").isNotNull()).withColumn("w", F.split("passage", " "))
    is_long = F.size("w") >= words + 2
    long = split.where(is_long).select("passage_id", F.xxhash64(F.slice("w", 2, words)).alias("h"))
    short = split.where(~is_long).select("passage_id", F.substring("passage", 1, letters).alias("h"))
    how = lambda df: "broadcast" if df.count() <= broadcast_rows else "merge"
    hashes = lambda w: F.when(F.size(w) >= words, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(F.slice(w, i, words)))))
    # the outer transform splits a text once; a plain column would be split anew for each window
    windows = texts.select("id", F.explode(F.transform(F.array(F.split("text", " ")), hashes)).alias("hs")).select("id", F.explode("hs").alias("h"))
    pairs = windows.join(long.hint(how(long)), "h").select("id", "passage_id")
    lengths = sorted(r[0] for r in short.select(F.length("h")).distinct().collect())  # at most `letters` + 1 numbers
    for n in lengths:
        if n:
            starts = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1))
            windows = texts.select("id", F.explode(F.array_distinct(letters_from(starts, n))).alias("h"))
        else:
            windows = texts.where(F.col("text").isNotNull()).select("id", F.lit("").alias("h"))
        own = short.where(F.length("h") == n)
        pairs = pairs.unionByName(windows.join(own.hint(how(own)), "h").select("id", "passage_id"))
    return pairs.distinct().join(passages.hint(how(passages)), "passage_id").join(texts.hint("merge"), "id").where(F.contains("text", "passage")).select("id", "passage_id")


def benchmark_faults(items: DataFrame, texts: DataFrame, answers: DataFrame, markers: list[str]) -> DataFrame:
    """(kind, faults) of a benchmark (passage_id, passage): only kinds with a fault have a row.

    leaked_item: in a text; repeated_item: a passage that several items have; misaligned_answer: answers (passage_id, of)
    whose digest is of another passage; hidden_marker: texts with one of the markers (expressions, in any case).
    """
    kinds = {
        "leaked_item": passages_in(texts, items).select("passage_id").distinct(),
        "repeated_item": repeated(items, "passage").select("n"),
        "misaligned_answer": misaligned(items.select("passage_id", F.md5("passage").alias("of")), answers, "passage_id", "of"),
        "hidden_marker": texts.where(F.col("text").rlike("(?i)" + "|".join(markers))),
    }
    out = None
    for kind, faults in kinds.items():
        one = faults.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("faults")).where("faults > 0")
        out = one if out is None else out.unionByName(one)
    return out


def lexical(rows: DataFrame, held_out: list[str], labels: int = 3, least: int = 20, over: float = 0.1, broadcast_rows: int = 200_000) -> DataFrame:
    """One row (status, train, test, accuracy, baseline, flagged): how well words alone tell the labels of texts whose groups weren't learnt from.

    rows: (id, text, label, grp), ids being unique; rows without a label or group are left out. Multinomial naive Bayes with add-one smoothing over lower-case words of letters,
    digits and _, learnt on the groups that aren't held out; words that weren't learnt don't count, and labels tie by name. The baseline is the most frequent learnt label (by
    name if several). Without exactly so many learnt labels, or with fewer tests than `least`, the status is insufficient_coverage and there is no figure. flagged:
    more than `over` above the baseline.

    Word counts are summed before the shuffle; a word's weights are an array with a place for each label, joined to the words of the tested texts:
    up to broadcast_rows words are broadcast. Rows that are dealt by id stay where they are, so the deal bounds what a task holds.
    """
    rows = rows.where("label is not null and grp is not null").withColumn("test", F.col("grp").isin(held_out))
    docs = rows.where("not test").groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda w: w != "")
    words = rows.select("id", "label", "test", F.explode(found).alias("w")).groupBy("id", "label", "test", "w").agg(F.count(F.lit(1)).alias("k"))
    learnt = words.where("not test").groupBy("label", "w").agg(F.sum("k").alias("k"))
    sums = learnt.groupBy("label").agg(F.sum("k").alias("total"))
    size = learnt.agg(F.count_distinct("w").alias("v"))
    # one row for each label, then one row
    model = docs.join(sums.hint("merge"), "label", "left").crossJoin(F.broadcast(size)).agg(F.array_sort(F.collect_list(F.struct("label", "docs", F.coalesce("total", F.lit(0)).alias("total")))).alias("labels"), F.max("v").alias("v"), F.sum("docs").alias("train"))
    by_word = learnt.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("label", "k"))).alias("ks"))  # an entry for each label
    weigh = F.transform("labels", lambda x: F.ln((F.coalesce(F.try_element_at("ks", x["label"]), F.lit(0)) + 1) / (x["total"] + F.col("v"))))
    weights = written(by_word.crossJoin(F.broadcast(model)).select("w", weigh.alias("weights")), "weights")
    how = "broadcast" if weights.count() <= broadcast_rows else "merge"
    scored = words.where("test").join(weights.hint(how), "w").select("id", F.posexplode(F.transform("weights", lambda x: x * F.col("k"))).alias("place", "s")).groupBy("id", "place").agg(F.sum("s").alias("s"))
    best = scored.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "s"))).alias("s"))
    tested = rows.where("test").select("id", "label").join(best.hint("merge"), "id", "left").crossJoin(F.broadcast(model))
    scores = F.transform("labels", lambda x, i: F.struct((-(F.ln(x["docs"] / F.col("train")) + F.coalesce(F.try_element_at("s", i), F.lit(0.0)))).alias("m"), x["label"].alias("label")))
    common = F.array_min(F.transform("labels", lambda x: F.struct((-x["docs"]).alias("m"), x["label"].alias("label"))))["label"]
    judged = tested.select((F.array_min(scores)["label"] == F.col("label")).cast("int").alias("right"), (common == F.col("label")).cast("int").alias("usual"))
    sizes = rows.agg(F.count_if(~F.col("test")).alias("train"), F.count_if("test").alias("test"), F.count_distinct(F.when(~F.col("test"), F.col("label"))).alias("n"))
    one = sizes.crossJoin(F.broadcast(judged.agg(F.avg("right").alias("accuracy"), F.avg("usual").alias("baseline"))))
    enough = (F.col("n") == labels) & (F.col("test") >= least)
    return one.select(F.when(enough, "completed").otherwise("insufficient_coverage").alias("status"), "train", "test", F.when(enough, F.col("accuracy")).alias("accuracy"), F.when(enough, F.col("baseline")).alias("baseline"), F.when(enough, F.col("accuracy") > F.col("baseline") + over).alias("flagged"))


def plan_faults(frozen: DataFrame, owned: DataFrame, sizes: DataFrame) -> DataFrame:
    """(fault, key) of a frozen plan (key, owner) against owners computed anew (key, owner), and against the sizes it states (owner, size).

    other_owner, unknown (the plan has a key that isn't there), missing (it lacks one), repeated (it has one twice), other_size (the key is the owner's name). No row is a pass.
    """
    mine = frozen.groupBy(F.col("key").cast("string").alias("key")).agg(F.min("owner").alias("planned"), F.count(F.lit(1)).alias("n"))
    both = mine.join(owned.select(F.col("key").cast("string").alias("key"), "owner").hint("merge"), "key", "full_outer")
    fault = F.when(F.col("owner").isNull(), "unknown").when(F.col("planned").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("planned") != F.col("owner"), "other_owner")
    counted = frozen.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).join(sizes.hint("merge"), "owner", "full_outer").where(~F.col("n").eqNullSafe(F.col("size")))
    return both.select(fault.alias("fault"), "key").where("fault is not null").unionByName(counted.select(F.lit("other_size").alias("fault"), F.col("owner").alias("key")))


def reference_faults(executed: DataFrame, reference: DataFrame, key: list[str], numbers: list[str], names: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(key columns, fault) of executed evidence that differs from an independent calculation.

    fault: only_executed, only_reference, or the first of numbers that differs by more than the tolerance (also a null against a number), or of names that isn't equal.
    """
    a = executed.select(*key, *[F.col(c).alias(f"a_{c}") for c in numbers + names], F.lit(True).alias("in_a"))
    b = reference.select(*key, *[F.col(c).alias(f"b_{c}") for c in numbers + names], F.lit(True).alias("in_b"))
    fault = F.when(F.col("in_b").isNull(), "only_executed").when(F.col("in_a").isNull(), "only_reference")
    for c in numbers:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        fault = fault.when(~x.eqNullSafe(y) & ~F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)), c)
    for c in names:
        fault = fault.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c)
    return a.join(b.hint("merge"), key, "full_outer").select(*key, fault.alias("fault")).where("fault is not null")
