"""Checks of written answers against the evidence they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of written answers: a cited id, a number, a unit, a year, and what follows a confidence level. Fixed values.
CITED = r"\b[A-Za-z][A-Za-z0-9_]*\.r[0-9]+\b"
PLAIN = r"[-−]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
UNIT = r"%|per ?cent\b|percentage points?\b|pp\b|points?\b"
TOKEN = rf"(?i)([<>≤≥]=?\s*)?({PLAIN})\s*({UNIT})?"
RANGE = rf"(?i)({PLAIN})(\s*(?:to|-|–|—|and)\s*)({PLAIN})(\s*)({UNIT})"
LEVEL = r"(?i)\b95\s*%?\s*(confidence|interval|credible|CI\b)"
YEAR = "^(?:19|20)[0-9]{2}$"
#: Bare whole numbers up to this one are wording ("top 2"), and the slack of a comparison of decimals.
WORDING, SLACK = 10, 1e-9


def cited_ids(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(CITED), F.lit(0))))


def sentences(answer: Column) -> Column:
    """The sentences of an answer: cut behind . ! ? and white space, and at line breaks."""
    return F.filter(F.transform(F.split(F.regexp_replace(answer, r"([.!?])\s+", "$1\n"), "\n"), F.trim), lambda x: x != "")


def once(value: Column, use) -> Column:
    """use(value) with value computed once, however often the lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(sentence: Column) -> Column:
    """(cmp, number, unit) of each number of a sentence; cited ids and confidence levels are left out.

    The first number of a range takes the unit that is written behind the second.
    """
    # each pass over a long sentence is made once, and only where there is what it looks for
    text = once(sentence, lambda s: F.when(F.contains(s, F.lit(".r")), F.regexp_replace(s, CITED, " ")).otherwise(s))
    text = once(text, lambda s: F.when(F.contains(s, F.lit("95")), F.regexp_replace(s, LEVEL, " $1")).otherwise(s))
    text = F.regexp_replace(text, RANGE, "$1$5 $2$3$5")
    part = lambda x, i: F.regexp_extract(x, TOKEN, i)
    each = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.struct(F.trim(part(x, 1)).alias("cmp"), F.translate(F.replace(part(x, 2), F.lit(","), F.lit("")), "−", "-").alias("number"), F.lower(part(x, 3)).alias("unit")))
    none = F.array().cast("array<struct<cmp:string,number:string,unit:string>>")
    return F.when(~sentence.rlike("[0-9]"), none).otherwise(each)


def label_numbers(text: Column) -> Column:
    """The numbers inside a label, without their sign: repeating them claims nothing."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)), lambda x: F.regexp_replace(x, "[,−-]", "")))


def exempt(token: Column, known: Column) -> Column:
    """Whether a number needs no evidence: a year, one of the claim or of a label, or small and bare."""
    bare = (token["unit"] == "") & (token["cmp"] == "")
    year = token["number"].rlike(YEAR) & (token["unit"] == "")
    small = bare & ~F.contains(token["number"], F.lit(".")) & (token["number"].cast("double") <= WORDING)
    return year | F.array_contains(known, F.regexp_replace(token["number"], "^-", "")) | small


def grounded(token: Column, counts: Column, shares: Column, reals: Column, ps: Column) -> Column:
    """Whether a value of the pack (arrays of doubles) stands behind a number, at the decimals that are written.

    A bound holds if some value keeps it; a number in scientific form must agree at its figures; one with a unit is a share in
    hundredths; a bare whole number may be a count; any other must be near a value, or, over 1, near a share in hundredths.
    """
    shown = token["number"].cast("double")
    decimals = F.length(F.regexp_extract(token["number"], r"\.([0-9]+)", 1))
    half = F.lit(0.5) * F.pow(F.lit(10.0), -decimals)
    close = lambda v: F.abs(F.abs(shown) - F.abs(v)) <= half + SLACK
    all_ = F.concat(ps, shares, reals)
    below = token["cmp"].startswith("<") | token["cmp"].startswith("≤")
    bound = F.exists(all_, lambda p: F.when(below, p < shown).otherwise(p > shown))
    scientific = F.exists(all_, lambda v: F.abs(shown - v) <= half * F.greatest(F.abs(shown), F.abs(v)) + 1e-15)
    hundredths = F.exists(shares, lambda v: close(v * 100.0))
    other = ((decimals == 0) & F.array_contains(counts, F.abs(shown))) | F.exists(all_, close) | ((F.abs(shown) > 1) & hundredths)
    return F.when(token["cmp"] != "", bound).when(token["number"].rlike("[eE]"), scientific).when(token["unit"] != "", hundredths).otherwise(other)


def mentions(sentence: Column, label: Column) -> Column:
    """Whether a sentence names a group as a word of its own, in any case."""
    word = lambda x: F.concat(F.lit(" "), F.regexp_replace(F.lower(x), "[^a-z0-9_]+", " "), F.lit(" "))
    return F.contains(word(sentence), word(label))


def check_answers(packs: DataFrame) -> DataFrame:
    """(pack, d1_cited, d2_grounded, d3_shown, d4_required, ungrounded, review) of answers.

    packs: (pack, answer, ids, required, known, counts, shares, reals, ps, reported, hidden), the last two arrays of group labels
    and of (label, n). D1: every cited id is one of the pack. D2: every number that isn't exempt is grounded. D3: no sentence that
    names a hidden group, and no reported one, has a percentage or a decimal but the group's own base. D4: every required id is cited. A
    sentence that names both kinds of group isn't a fault but is left for a reader (review). An answer's numbers are looked at
    within its row; no answer is joined to others.
    """
    found = packs.withColumns({"said": sentences(F.col("answer")), "cited": cited_ids(F.col("answer"))})
    found = found.withColumn("said", F.transform("said", lambda s: F.struct(s.alias("text"), tokens(s).alias("tokens"))))
    pool = [F.col(c) for c in ("counts", "shares", "reals", "ps")]
    wrong = F.flatten(F.transform("said", lambda s: F.transform(F.filter(s["tokens"], lambda t: ~exempt(t, F.col("known")) & ~grounded(t, *pool)), lambda t: t["number"])))
    telling = lambda s, h: F.exists(s["tokens"], lambda t: (t["unit"] != "") | (F.contains(t["number"], F.lit(".")) & (t["number"].cast("double") != h["n"])))
    names = lambda s, mixed: F.exists(F.col("hidden"), lambda h: mentions(s["text"], h["label"]) & telling(s, h) & (F.exists("reported", lambda g: mentions(s["text"], g)) == mixed))
    return found.select(
        "pack",
        (F.size(F.array_except("cited", "ids")) == 0).alias("d1_cited"),
        (F.size(wrong) == 0).alias("d2_grounded"),
        (~F.exists("said", lambda s: names(s, F.lit(False)))).alias("d3_shown"),
        (F.size(F.array_except("required", "cited")) == 0).alias("d4_required"),
        F.array_join(F.array_sort(wrong), " ").alias("ungrounded"),
        F.exists("said", lambda s: names(s, F.lit(True))).alias("review"),
    )


def normal(text: Column) -> Column:
    """Quotes and white space made plain, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "’‘“”", "''\"\"")), r"\s+", " "))


def quote_found(quote: Column, answer: Column) -> Column:
    """Whether every fragment of a quote, between ellipses, is in the answer."""
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), normal), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: F.contains(normal(answer), x))


def unfenced(text: Column) -> Column:
    """A response without the one code fence around all of it."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```[a-z]*\n(.*?)\n?```$", 1)
    return F.when(F.trim(text).rlike(r"(?s)^```[a-z]*\n.*```$"), inner).otherwise(text)
