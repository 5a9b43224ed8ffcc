import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import answers, audits, curriculum, families, gates, selection
from tallywright.operators.numbering import numbered
from tallywright.plans import QUERIES
from tallywright.sources import files, studies


def test_planted_split_leak(spark):
    rows = spark.createDataFrame([("f1", "i1", "train"), ("f1", "i2", "test"), ("f2", "i2", "test"), (None, "i3", "train")], "family string, input string, split string")
    assert {(r.kind, r.key) for r in audits.split_leaks(rows, {"family": "family", "input": "input"}).collect()} == {("family", "f1")}


def test_differences_and_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert {(r.k, r.side) for r in audits.differences(a, b).collect()} == {(2, "left"), (3, "right")}
    assert [r.k for r in audits.misaligned(a.distinct(), b, "k", "v").collect()] == [3]


def test_passages(spark):
    t = spark.createDataFrame([(1, "xxone two three four five six sevenyy"), (2, "one two three"), (3, None), (4, "")], "id int, text string")
    p = spark.createDataFrame([(9, "one two three four five six seven"), (8, "short one")], "passage_id int, passage string")
    for rows in (200_000, 0, 1):  # keys broadcast, and keys joined by hash
        assert [tuple(r) for r in audits.passages_in(t, p, broadcast_rows=max(1, rows)).collect()] == [(1, 9)]
    p = p.union(spark.createDataFrame([(7, "two three"), (6, None)], "passage_id int, passage string"))
    assert {tuple(r) for r in audits.passages_in(t, p).collect()} == {(1, 9), (1, 7), (2, 7)}


PACK = {"ids": ["s1.r1", "s1.r2"], "required": ["s1.r1"], "known": ["18", "24"], "counts": [2389.0, 1178.0], "shares": [0.4931, 0.0312, 0.1908], "reals": [1.82], "ps": [0.00042], "reported": ["Adults"], "hidden": [("Tiny", 7.0)]}
ANSWERS = [  # answer, citations, numbers, hidden groups, required ids, numbers that nothing stands behind
    ("It is 49.3% of 2,389 [s1.r1].", True, True, True, True, ""),
    ("It is 49.4% [s1.r1].", True, False, True, True, "49.4"),
    ("From 3.1 to 19.1 percentage points [s1.r1].", True, True, True, True, ""),
    ("In 2024, at the 95% confidence level, the top 3 of those aged 18-24 [s1.r1].", True, True, True, True, ""),
    ("p < 0.001 [s1.r1], that is 4.2e-4; not p < 0.0001.", True, False, True, True, "0.0001"),
    ("A ratio of 1.82, not 1.92 [s1.r1].", True, False, True, True, "1.92"),
    ("See s9.r4 for 1,178 people.", False, True, True, False, ""),
    ("The Tiny group has 49.3% [s1.r1].", True, True, False, True, ""),
    ("The tiny group has 7 people [s1.r1].", True, True, True, True, ""),
    ("Tiny and adults have 49.3% [s1.r1].", True, True, True, True, ""),
    ("", True, True, True, False, ""),
]


def test_answers(spark):
    rows = [(i, a, *PACK.values()) for i, (a, *_) in enumerate(ANSWERS)]
    packs = spark.createDataFrame(rows, "pack int, answer string, ids array<string>, required array<string>, known array<string>, counts array<double>, shares array<double>, reals array<double>, ps array<double>, reported array<string>, hidden array<struct<label: string, n: double>>")
    got = {r.pack: (r.d1_cited, r.d2_grounded, r.d3_shown, r.d4_required, r.ungrounded) for r in answers.check_answers(packs).collect()}
    assert got == {i: tuple(x) for i, (_, *x) in enumerate(ANSWERS)}
    assert [r.pack for r in answers.check_answers(packs).where("review").collect()] == [9]
    q = spark.range(1).select(answers.quote_found(F.lit("The ‘big’ ... end"), F.lit("the 'BIG'  one at the end")).alias("a"), answers.quote_found(F.lit("..."), F.lit("x")).alias("b"), answers.unfenced(F.lit("```py\nx = 1\n```")).alias("c"), answers.unfenced(F.lit("a ```b```")).alias("d")).first()
    assert (q.a, q.b, q.c, q.d) == (True, False, "x = 1", "a ```b```")


@pytest.mark.parametrize("most", [200_000, 0])
def test_passages_of_any_length(spark, most):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "x  y"), (93, "long " * 3000)]
    whole = [t for _, t in texts if t]
    passages = [(i, t[a : a + rng.randint(1, 60)]) for i in range(60) for t in [rng.choice(whole)] for a in [rng.randrange(len(t))]] + [(100, ""), (101, None), (102, "not there"), (103, " "), (104, "bathe cats and dogs in the sea"), (103, "ab")]
    got = audits.passages_in(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(passages, "passage_id int, passage string"), broadcast_rows=most)
    found = [tuple(r) for r in got.distinct().collect()]
    assert set(found) == {(i, p) for i, t in texts for p, x in passages if t is not None and x is not None and x in t}


def greedy(rows, needs, size, seed):
    """The selection one candidate at a time, by the rule of the docstring."""
    order = {i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i, _, _ in rows}
    ok = lambda t, r: set(r.split("&")) <= set(t)
    chosen, free, got = [], list(rows), dict.fromkeys(needs, 0)

    def take(x):
        nonlocal free
        chosen.append(x)
        free = [y for y in free if y is not x and not set(x[1]) & set(y[1])]
        for r in needs:
            got[r] += ok(x[2], r)

    while len(chosen) < size and any(got[r] < n for r, n in needs.items()):
        lacks = {r: n - got[r] for r, n in needs.items() if got[r] < n}
        there = {r: [x for x in free if ok(x[2], r)] for r in lacks}
        if any(len(there[r]) < n for r, n in lacks.items()):
            break
        r = min(lacks, key=lambda r: (len(there[r]) / lacks[r], r))
        take(min(there[r], key=lambda x: (-sum(1.0 / needs[q] if ok(x[2], q) else 0.0 for q in lacks), order[x[0]])))
    if all(got[r] >= n for r, n in needs.items()):
        stratum = lambda x: "|".join(sorted(x[2]))
        while free and len(chosen) < size:
            s = min({stratum(x) for x in free}, key=lambda s: (sum(stratum(c) == s for c in chosen), s))
            take(min((x for x in free if stratum(x) == s), key=lambda x: order[x[0]]))
    short = {(r, n, got[r]) for r, n in needs.items() if got[r] < n} | ({("size", size, len(chosen))} if len(chosen) < size else set())
    return [x[0] for x in chosen], short


SELECTIONS = [
    ([(1, [1, 2], ["x", "y"]), (2, [1], ["z"]), (3, [3], ["x", "y"])], {"x": 1, "y": 1, "z": 1}, 2, 1),  # z is scarcest: 2 and 3 meet all
    ([(i, [i // 2, 100 + i], ["a" if i % 4 else "b", "x" if i < 10 else "y"]) for i in range(40)], {"b": 4, "a&x": 3, "z": 2}, 12, 1),
    ([(i, [i // 2, 100 + i], ["a" if i % 4 else "b", "x" if i < 10 else "y"]) for i in range(40)], {"b": 1}, 50, 1),
    ([(i, [] if i % 3 else [1], ["a"]) for i in range(12)], {"a": 2}, 9, 2),  # a core that a third share, and rows without any
    *[([(i, random.Random(s * 99 + i).sample(range(25), 2), random.Random(s * 77 + i).sample("abcde", 2)) for i in range(60)], {"a": 3, "b&c": 1, "d": 3, "e": 2}, 11, s) for s in range(4)],
]


@pytest.mark.parametrize("most", [50_000, 3])
@pytest.mark.parametrize(("rows", "needs", "size", "seed"), SELECTIONS)
def test_covering_selection(spark, rows, needs, size, seed, most, monkeypatch):
    monkeypatch.setattr(selection, "REWRITE", 6)
    df = spark.createDataFrame([(*r, 1, "o") for r in rows], "id int, cores array<int>, tags array<string>, held int, other string").repartition(3)
    ids, want = greedy(rows, needs, size, seed)
    chosen, short = selection.covering(df, needs, size, seed, ahead=16, most=most)
    got = chosen.collect()
    assert [r.id for r in got] == ids and {tuple(r) for r in short.collect()} == want
    cores = [c for r in got for c in r.cores]
    assert len(cores) == len(set(cores))


def many(n):
    return [(i, [i % 997, 1000 + i // 3], ["a" if i % 4 else "b", "x" if i % 10 < 7 else "y", "z" if i % 50 == 3 else "w"]) for i in range(n)]


@pytest.mark.parametrize("ahead", [512, 16])
def test_covering_selection_takes_few_scans(spark, ahead, monkeypatch):
    rows, needs, calls = many(2000), {"b": 9, "a&x": 12, "z": 4, "y": 14}, []
    for name in ("written", "excluded"):
        monkeypatch.setattr(selection, name, lambda *a, f=getattr(selection, name), name=name: calls.append(name) or f(*a))
    ids, want = greedy(rows, needs, 60, 3)
    chosen, short = selection.covering(spark.createDataFrame(rows, "id int, cores array<int>, tags array<string>"), needs, 60, 3, ahead)
    assert [r.id for r in chosen.collect()] == ids and {tuple(r) for r in short.collect()} == want
    assert calls.count("written") == 1 and (calls.count("excluded") == 1 or ahead < 512)  # over a hundred cores are taken, and four requirements met


def test_covering_selection_looks_further_if_lists_are_empty(spark, monkeypatch):
    rows, needs, wides = many(300), {"b": 2, "z": 1}, []

    def firsts(free, by, there, few, wide, real=selection.firsts):
        wides.append(wide)
        return real(free, by, there, few, wide) if wide > 1 else {x: [] for x in there}

    monkeypatch.setattr(selection, "firsts", firsts)
    df = spark.createDataFrame(rows, "id int, cores array<int>, tags array<string>")
    chosen, _ = selection.covering(df, needs, 6, 3)
    assert [r.id for r in chosen.collect()] == greedy(rows, needs, 6, 3)[0] and set(wides) == {1, 64}


def test_covering_selection_of_nothing(spark):
    none = spark.createDataFrame([(1, None, None), (2, [None], ["a", None])], "id int, cores array<int>, tags array<string>")
    chosen, short = selection.covering(none, {"a": 1}, 3, 0)
    assert {r.id for r in chosen.collect()} == {1, 2} and [tuple(r) for r in short.collect()] == [("size", 3, 2)]
    chosen, short = selection.covering(none.limit(0), {"a": 1}, 2, 0)
    assert chosen.count() == 0 and {tuple(r) for r in short.collect()} == {("a", 1, 0), ("size", 2, 0)}


def test_studies_on_disk(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, " red ", True), (2, "blue", None)], "respondent_id int, colour string, box boolean")
    df.write.parquet(str(tmp_path / "answers"))
    card = {"label": "x", "block_id": "b", "answer_type": "single", "values": ["red", "blue"], "ordered_values": None, "flags": [], "denominator_rule": "answered"}
    cards = [{**card, "id": "colour"}, {**card, "id": "box", "answer_type": "select_all"}]

    def load(cards):
        (tmp_path / "m.json").write_text(json.dumps({"hash": "h", "study": {}, "variables": cards}))
        return studies.load_study(spark, str(tmp_path / "answers"), str(tmp_path / "m.json"))

    got, catalogue, study = load(cards)
    assert {r.colour for r in got.collect()} == {"red", "blue"} and catalogue.count() == 2 and study.blocks == {"b": ["box"]}
    for bad, error in (({**card, "id": "none"}, "MissingColumn"), ({**card, "id": "colour", "answer_type": "essay"}, "InvalidMetadata"), ({**card, "id": "colour", "answer_type": "ordered_scale"}, "InvalidMetadata"), ({**card, "id": "colour", "answer_type": "select_all"}, "InvalidData"), ({**card, "id": "colour", "label": ""}, "InvalidMetadata")):
        with pytest.raises(ValueError, match=error):
            load([bad])
    with pytest.raises(ValueError, match="repeated"):
        load([cards[0], cards[0]])


def test_gates(spark):
    rows = spark.createDataFrame([("a", 1, "v"), ("a", 2, "v"), ("b", 1, "v"), ("c", 1, "v")], "scope string, record_id int, version string")
    gate = spark.createDataFrame([("a", 2, "v"), ("a", 1, "v"), ("b", 2, "v"), ("c", 1, "w"), ("d", 1, "v")], rows.schema)
    assert {r.scope: r.error for r in gates.scope_faults(gate, rows).collect()} == {"a": "", "b": "OtherRecords", "c": "OtherVersion", "d": "OtherRecords"}


def test_quotas_and_selection(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "s string")
    assert {r.s: r.quota for r in families.quotas(df, "s", 7).collect()} == {"a": 4, "b": 2, "c": 1}
    c = spark.createDataFrame([("x", 3.0, 1), ("x", 3.0, 2), ("y", 2.0, 2), ("y", 2.0, 3), ("z", 1.0, 3)], "id string, score double, core int")
    assert {r.id for r in families.select_disjoint(c).collect()} == {"x", "z"}


def test_selection_goes_on_until_no_candidate_is_left(spark):
    n = 14  # a chain: each round takes one
    c = spark.createDataFrame([(i, float(n - i), k) for i in range(n) for k in (i, i + 1)], "id long, score double, core int")
    assert {r.id for r in families.select_disjoint(c).collect()} == set(range(0, n, 2))
    with pytest.raises(RuntimeError):
        families.select_disjoint(c, most_rounds=3)
    assert families.select_disjoint(c.limit(0)).count() == 0


def test_files(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    files.write_jsonl(df, path)
    assert files.read_jsonl(spark, path, "id int, v string").count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "none"), "id int").count() == 0
    listed = files.manifest(spark, path)
    assert files.verify(spark, path, listed).isEmpty() and not files.verify(spark, path, listed.withColumn("sha256", F.lit("x"))).isEmpty()
    parted = str(tmp_path / "parted")
    df.coalesce(1).write.partitionBy("id").json(parted)  # both folders have a file of the same name
    both = files.manifest(spark, parted).collect()
    assert len({r.name for r in both}) == 2 and all(r.name.startswith("id=") for r in both)
    assert files.verify(spark, parted, files.manifest(spark, parted)).isEmpty()
    torn = tmp_path / "torn.jsonl"
    torn.write_text('{"id": 1}\n\n{"id": 2}\n{"id": 3')
    assert sorted(r.id for r in files.read_torn(spark, str(torn), "id int").collect()) == [1, 2]
    assert files.publish(df, str(tmp_path / "p"), df.limit(0)) and not files.publish(df, str(tmp_path / "p"), df.limit(0)) and not files.publish(df, str(tmp_path / "q"), df)


def test_numbering(spark):
    rows = numbered(spark.range(1000).selectExpr("(id * 37) % 1000 as k", "id"), "k").collect()
    assert all(r.pos == r.k + 1 for r in rows) and len(rows) == 1000
    assert numbered(spark.range(0), "id").isEmpty()
    assert [r.at for r in numbered(spark.createDataFrame([(1,), (1,), (None,)], "k int"), "k", name="at", start=0).orderBy("at").collect()] == [0, 1, 2]


def test_normal_text(spark, tmp_path):
    spark.createDataFrame([(1, "Ｆull ﬁt, STRASSE ß"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.text for r in QUERIES["c10_normal_text"](spark, str(tmp_path)).collect()} == {1: "full fit strasse ss", 2: "", 3: ""}


def test_normal_text_streams_in_small_steps(spark, tmp_path):
    spark.createDataFrame([(i, "ﬁt ＡＢ é " * (i % 3)) for i in range(700)] + [(None, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["c10_normal_text"](spark, str(tmp_path))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.text) for r in found.collect()} == {(i, " ".join(["fit ab é"] * (i % 3))) for i in range(700)} | {(None, "")}


def test_numbers_take_one_pass(spark):
    said = ["", None, "no number", "5 percentage", "2 to 3% of .r5 x1.r2", "<= 1,000 points and 95% CI", "95 % confidence, 7 to 8 pp", "−3.5e-2 percent"]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, s string").select("i", answers.tokens(F.col("s")).alias("t"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    got = {r.i: r.t and [tuple(x) for x in r.t] for r in found.collect()}
    assert got[0] == [] and got[1] is None and got[2] == [] and got[3] == [("", "5", "")] and got[4] == [("", "2", "%"), ("", "3", "%"), ("", "5", "")]
    assert got[5] == [("<=", "1000", "points")] and got[6] == [("", "7", "pp"), ("", "8", "pp")] and got[7] == [("", "-3.5e-2", "percent")]
