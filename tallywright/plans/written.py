"""Queries of written answers: citations, numbers, quotes and the four checks, on answers with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import stats
from tallywright.operators import answers

from .details import _DEBT, debts
from .estimation import WHI, WLO
from .registry import query

CLAIM = "Debt is common among people aged 18-24."
#: The fault that is planted in an answer, by the nation's number modulo nine.
FAULTS = ["none", "share", "id", "uncited", "hidden", "base", "bound", "scientific", "mixed"]


def packs(spark, sf_dir):
    """The evidence on each nation's share of customers in debt, and an answer with one fault or none."""
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    d = debts(spark, sf_dir).withColumns({"value": F.col("k") / F.col("n"), "lo": lo, "hi": hi, "fault": F.element_at(F.array(*map(F.lit, FAULTS)), (F.col("nation") % 9 + 1).cast("int")), "id": F.concat(F.lit("s1.r"), "nation")})
    is_ = lambda f, x, y="": F.when(F.col("fault") == f, x).otherwise(F.lit(y) if isinstance(y, str) else y)
    pct = lambda c: F.format_string("%.1f", 100 * c)
    text = F.concat(
        F.lit("In 2024 "), pct(is_("share", F.col("value") + 0.3, F.col("value"))), F.lit("% of "), is_("base", F.col("n") + 1, F.col("n")).cast("string"),
        F.lit(" customers (95% confidence interval "), pct(F.col("lo")), F.lit(" to "), pct(F.col("hi")), F.lit(" percentage points) are in debt"), is_("uncited", F.lit(""), F.concat(F.lit(" ["), "id", F.lit("]"))),
        is_("id", F.lit(" [s9.r1]")), F.lit(". The top 3 nations differ, also at 18-24."), is_("hidden", F.lit(" The Tiny group has 12.5%.")), is_("bound", F.lit(" This holds at z > 99.")),
        is_("scientific", F.concat(F.lit(" As a share, "), F.format_string("%.2e", F.col("value")), F.lit("."))), is_("mixed", F.lit(" Tiny and the Nation reach 12.5%.")),
    )
    one = lambda c: F.array(F.col(c).cast("double"))
    return d.select(
        F.col("nation").alias("pack"), "fault", text.alias("answer"), F.array("id", F.lit("s1.r999")).alias("ids"), F.array("id").alias("required"), answers.label_numbers(F.lit(CLAIM)).alias("known"),
        F.concat(one("n"), one("k")).alias("counts"), F.concat(one("value"), one("lo"), one("hi")).alias("shares"), F.array(F.lit(1.5)).alias("reals"), F.array(F.lit(0.04)).alias("ps"),
        F.array(F.lit("Nation")).alias("reported"), F.array(F.struct(F.lit("Tiny").alias("label"), F.lit(4.0).alias("n"))).alias("hidden"),
    )


_IS = lambda f, x, y="''": f"CASE WHEN fault = '{f}' THEN {x} ELSE {y} END"
_SAID = f"""WITH d AS (SELECT nation AS pack, n, k, k / n::DOUBLE AS value, {WLO('k', 'n')} AS lo, {WHI('k', 'n')} AS hi, {FAULTS}[nation % 9 + 1] AS fault, 's1.r' || nation AS id FROM ({_DEBT})),
a AS (SELECT *, concat('In 2024 ', printf('%.1f', 100 * {_IS('share', 'value + 0.3', 'value')}), '% of ', {_IS('base', 'n + 1', 'n')}, ' customers (95% confidence interval ', printf('%.1f', 100 * lo), ' to ', printf('%.1f', 100 * hi), ' percentage points) are in debt', {_IS('uncited', "''", "concat(' [', id, ']')")},
 {_IS('id', "' [s9.r1]'")}, '. The top 3 nations differ, also at 18-24.', {_IS('hidden', "' The Tiny group has 12.5%.'")}, {_IS('bound', "' This holds at z > 99.'")}, {_IS('scientific', "concat(' As a share, ', printf('%.2e', value), '.')")}, {_IS('mixed', "' Tiny and the Nation reach 12.5%.'")}) AS answer FROM d),
s AS (SELECT pack, n, k, value, lo, hi, unnest(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1\n', 'g'), '\n')) AS said FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(said, '{answers.CITED}', ' ', 'g'), '{answers.LEVEL}', ' \\1', 'g'), '{answers.RANGE}', '\\1\\5 \\2\\3\\5', 'g') AS clean FROM s),
t AS (SELECT pack, n, k, value, lo, hi, said, unnest(regexp_extract_all(clean, '{answers.TOKEN}', 1)) AS cmp, replace(replace(unnest(regexp_extract_all(clean, '{answers.TOKEN}', 2)), ',', ''), '−', '-') AS number, unnest(regexp_extract_all(clean, '{answers.TOKEN}', 3)) AS unit FROM c),
x AS (SELECT * REPLACE (trim(coalesce(cmp, '')) AS cmp, lower(coalesce(unit, '')) AS unit), number::DOUBLE AS shown, 0.5 * pow(10.0, -len(regexp_extract(number, '\\.([0-9]+)', 1))) AS half, len(regexp_extract(number, '\\.([0-9]+)', 1)) AS decimals, [0.04, value, lo, hi, 1.5] AS pool, [value, lo, hi] AS shares FROM t),
e AS (SELECT *, CASE WHEN regexp_full_match(number, '(19|20)[0-9][0-9]') AND unit = '' THEN 'year' WHEN regexp_replace(number, '^-', '') IN ('18', '24') THEN 'claim' WHEN unit = '' AND cmp = '' AND NOT contains(number, '.') AND shown <= 10 THEN 'small' ELSE 'checked' END AS kind,
 CASE WHEN cmp <> '' THEN len([1 for v in pool if CASE WHEN cmp[1] IN ('<', '≤') THEN v < shown ELSE v > shown END]) > 0 WHEN regexp_matches(number, '[eE]') THEN len([1 for v in pool if abs(shown - v) <= half * greatest(abs(shown), abs(v)) + 1e-15]) > 0
 WHEN unit <> '' THEN len([1 for v in shares if abs(abs(shown) - abs(100 * v)) <= half + 1e-9]) > 0
 ELSE (decimals = 0 AND abs(shown) IN (n, k)) OR len([1 for v in pool if abs(abs(shown) - abs(v)) <= half + 1e-9]) > 0 OR (abs(shown) > 1 AND len([1 for v in shares if abs(abs(shown) - abs(100 * v)) <= half + 1e-9]) > 0) END AS ok FROM x) """
_TINY, _NATION = ("contains(' ' || regexp_replace(lower(said), '[^a-z0-9_]+', ' ', 'g') || ' ', ' %s ')" % x for x in ("tiny", "nation"))
_TELLS = "(unit <> '' OR (contains(number, '.') AND shown <> 4))"


@query("k05_citations", _SAID + f"SELECT pack, cited, cited IN (id, 's1.r999') AS valid FROM (SELECT DISTINCT pack, id, unnest(regexp_extract_all(answer, '{answers.CITED}')) AS cited FROM a)")
def citations(spark, sf_dir):
    """Ids that an answer cites, and whether its pack has them."""
    return packs(spark, sf_dir).select("pack", "ids", F.explode(answers.cited_ids(F.col("answer"))).alias("cited")).select("pack", "cited", F.array_contains("ids", F.col("cited")).alias("valid"))


def tokens(spark, sf_dir):
    """Every number of every answer, with its sentence's place and the arrays of its pack."""
    each = packs(spark, sf_dir).select("*", F.posexplode(answers.sentences(F.col("answer"))).alias("sentence", "said"))
    return each.select("*", F.explode(answers.tokens(F.col("said"))).alias("t"))


@query("k09_ungrounded_numbers", _SAID + "SELECT pack, cmp, number, unit FROM e WHERE kind = 'checked' AND NOT ok")
def ungrounded_numbers(spark, sf_dir):
    """Numbers with no value behind them: units, bounds, scientific form and the range's unit are read."""
    t = tokens(spark, sf_dir).where(~answers.exempt(F.col("t"), F.col("known")) & ~answers.grounded(F.col("t"), *[F.col(c) for c in ("counts", "shares", "reals", "ps")]))
    return t.select("pack", "t.cmp", "t.number", "t.unit")


@query("k10_exempt_numbers", _SAID + "SELECT kind = 'checked' AS checked, number, count(*) AS n FROM e WHERE kind <> 'checked' OR unit = '' GROUP BY 1, 2")
def exempt_numbers(spark, sf_dir):
    """Numbers that need no evidence (years, those of the claim, small ones; a confidence level isn't a number), and other bare ones."""
    free = answers.exempt(F.col("t"), F.col("known"))
    return tokens(spark, sf_dir).where(free | (F.col("t.unit") == "")).groupBy((~free).alias("checked"), F.col("t.number").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("k11_answer_checks", _SAID + f""", w AS (SELECT pack, string_agg(number, ' ' ORDER BY number) FILTER (kind = 'checked' AND NOT ok) AS wrong, bool_or({_TINY} AND NOT {_NATION} AND {_TELLS}) AS hidden, bool_or({_TINY} AND {_NATION} AND {_TELLS}) AS review FROM e GROUP BY 1)
SELECT pack, NOT contains(answer, '[s9.r1]') AS d1_cited, wrong IS NULL AS d2_grounded, NOT hidden AS d3_shown, contains(answer, '[' || id || ']') AS d4_required, coalesce(wrong, '') AS ungrounded, review FROM a JOIN w USING (pack)""")
def answer_checks(spark, sf_dir):
    """Four checks of each answer: valid citations, grounded numbers, nothing hidden told, every required id cited."""
    return answers.check_answers(packs(spark, sf_dir))


@query("k12_quotes", f"WITH q AS (SELECT nation, CASE nation % 4 WHEN 0 THEN 'The  FIRST …  of nation' WHEN 1 THEN 'the second part' WHEN 2 THEN '…' ELSE 'the last ‘words’ of nation ' || nation END AS quote, 'The first half ’x’ of nation ' || nation || '. And the last ’words’ of nation ' || nation || '.' AS answer FROM ({_DEBT})) SELECT nation, CASE nation % 4 WHEN 0 THEN true WHEN 3 THEN true ELSE false END AS found FROM q")
def quotes(spark, sf_dir):
    """Quotes with ellipses, other marks and spaces, some of which the answer lacks and some of which are empty."""
    n = F.col("nation").cast("string")
    quote = F.when(F.col("nation") % 4 == 0, "The  FIRST …  of nation").when(F.col("nation") % 4 == 1, "the second part").when(F.col("nation") % 4 == 2, "…").otherwise(F.concat(F.lit("the last ‘words’ of nation "), n))
    answer = F.concat(F.lit("The first half ’x’ of nation "), n, F.lit(". And the last ’words’ of nation "), n, F.lit("."))
    return debts(spark, sf_dir).select("nation", answers.quote_found(quote, answer).alias("found"))


_FENCED = "CASE c_custkey % 4 WHEN 0 THEN '```python\n' || c_name || '\n```' WHEN 1 THEN 'Here: ```' || c_name || '```' WHEN 2 THEN '```\n' || c_name || '\n```\nend' ELSE ' ```' || c_name END"


@query("k19_code_fences", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Here: ```' || c_name || '```' WHEN 2 THEN '```\n' || c_name || '\n```\nend' ELSE ' ```' || c_name END AS code FROM customer")
def code_fences(spark, sf_dir):
    """One fence around a whole response comes off; text before or behind it, or an open fence, leaves it as it is."""
    from .registry import table

    return table(spark, sf_dir, "customer").select("c_custkey", answers.unfenced(F.expr(_FENCED.replace("\n", "\\n"))).alias("code"))
