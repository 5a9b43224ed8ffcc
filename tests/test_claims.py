import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import claims
from tallywright.operators.specs import run_specs
from tallywright.streaming import results


def test_planted_changes(spark):
    text = "Riders walk more often than drivers. More than half say 'trust'. This is only among people in Bern."
    kinds = claims.planted(F.lit(text), F.lit("Riders"), F.lit("drivers"), F.array(F.lit("cost"), F.lit("trust")), F.lit(2), F.lit(False), F.lit(True), F.lit(3))
    got = spark.range(1).select(*[x.alias(k) for k, x in kinds.items()]).first().asDict()
    assert got["flip_direction"].startswith("Riders walk less often than drivers. Fewer than half")
    assert got["swap_groups"].startswith("drivers walk more often than Riders")
    assert "More than a third say" in got["change_threshold"] and got["drop_part"].endswith("'trust'.")
    assert got["add_causal"] == text + claims.CAUSE and "Bern" not in got["drop_population"] and "'cost'" in got["swap_measure"]
    none = claims.planted(F.lit("Nothing here."), F.lit("a group"), F.lit("b"), F.array(F.lit("cost")), F.lit(1), F.lit(True), F.lit(False), F.lit(3))
    assert set(spark.range(1).select(*[x.alias(k) for k, x in none.items()]).first()) == {None}


def test_search_of_a_catalogue(spark):
    cards = spark.createDataFrame([("q1", 1, "Trust in banks", "trust", ["low", "high"], "money"), ("q2", 2, "Age of rider", "age", ["young", "old"], "people"), ("q3", 3, "Trust in shops", "trust", ["low", "high"], "people")], "id string, ordinal int, label string, block string, values array<string>, section string")
    asks = spark.createDataFrame([("TRUST",), ("yung",)], "ask string")
    got = {(r.ask, r.place): (r.id, r.score) for r in claims.find_variables(asks, cards, k=2).collect()}
    assert got["TRUST", 1] == ("q1", 1.0) and got["TRUST", 2] == ("q3", 1.0)
    assert got["yung", 1][0] == "q2" and got["yung", 1][1] == pytest.approx(8 / 9)
    assert {r.id for r in claims.find_variables(asks, cards, section="people").collect()} == {"q2", "q3"}
    with pytest.raises(ValueError, match="WrongSearch"):
        claims.find_variables(asks, cards, k=0)


def test_expectations(spark):
    found = spark.createDataFrame([("s1.r1", "consistent", "no_clear_difference"), ("s1.r2", "inconsistent", "inconsistent"), ("s1.r3", "no_clear_difference", "no_clear_difference"), ("s1.r4", "unavailable", "unavailable"), ("s1.r5", "not_tested", "not_tested")], "id string, label string, label_holm string")
    gaps = spark.createDataFrame([("g1", "not_measured"), ("g2", "proxy_variable"), ("g3", "caveat")], "id string, kind string")
    hidden = spark.createDataFrame([("s1.q1", "Tiny")], "id string, grp string")
    got = {r.item for r in claims.expectations(found, gaps, hidden, True).collect()}
    assert got == {"E1:s1.r1", "E9:s1.r1", "E1:s1.r2", "E2:s1.r3", "E11:s1.r4", "E3:g1", "E4:g2", "E7:s1.q1:Tiny", "E5", "E6", "E8", "E10"}
    assert {r.item for r in claims.expectations(found.limit(0), gaps.limit(0), hidden.limit(0), False).collect()} == {"E5", "E8"}


def test_specs_name_their_errors(spark):
    from tallywright.operators.filters import Study

    study = Study({"b": ["x"]}, {"r": ["low", "high"]}, {"r": ["low", "high"], "g": ["a", "c"]})
    df = spark.createDataFrame([(i, True if i % 2 else None, ["low", "high"][i % 3 > 0], ["a", "c"][i % 2]) for i in range(40)], "id int, x boolean, r string, g string")
    specs = [{"spec_id": "1", "op": "mean", "variable": "r", "by": "g"}, {"spec_id": "2", "op": "share", "variable": "g", "value": "z"}, {"spec_id": "3", "op": "compare", "of": "2"}, {"spec_id": "4", "op": "compare", "of": "1"}, {"spec_id": "5", "op": "share", "variable": "r", "value": "low", "by": "g"}, {"spec_id": "6", "op": "compare", "of": "5", "expect": "higher"}, {"spec_id": "7", "op": "adjusted", "variable": "r", "value": "low", "by": "g", "a": "a", "b": "c", "controls": ["r"]}]
    got = run_specs(df, study, specs).collect()
    assert {r.spec_id: r.error for r in got} == {"1": "", "2": "UnknownValue", "3": "UnknownEstimate", "4": "WrongAnswerType", "5": "", "6": "WrongExpectation", "7": "WrongControls"}
    means = {r.grp: r.value for r in got if r.spec_id == "1"}
    assert means["a"] == pytest.approx(sum(1 + (i % 3 > 0) for i in range(0, 40, 2)) / 20)


@pytest.mark.parametrize("block", [2000, 7])
def test_search_by_bound_equals_all_pairs(spark, block):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aabcdeßéX ") for _ in range(rng.randint(0, 12)))
    cards = [(f"q{i}", i, word(), rng.choice(["same", word()]), [word() for _ in range(rng.randint(0, 4))] if i % 9 else None, rng.choice("st")) for i in range(60)]
    asks = [word() for _ in range(40)] + ["", "same", "SAME", "ss", "nothing like it"]
    df = spark.createDataFrame(cards, "id string, ordinal int, label string, block string, values array<string>, section string")
    for k, section in ((3, None), (10, "s")):
        want = set()
        for ask in set(asks):
            best = []
            for i, at, label, blk, values, sec in cards:
                if section in (None, sec):
                    score = max(claims.likeness(ask.casefold(), t.casefold()) for t in (i, label, blk, *(values or [])))
                    if score >= 0.3:
                        best.append((-score, at, i))
            want |= {(ask, i, -s, n) for n, (s, _, i) in enumerate(sorted(best)[:k], 1)}
        got = claims.find_variables(spark.createDataFrame([(a,) for a in [*asks, None, "same"]], "ask string"), df, k=k, section=section, block=block)
        assert {tuple(r) for r in got.collect()} == want
    assert claims.find_variables(df.select(F.col("id").alias("ask")).limit(0), df).count() == 0


SCHEMA = "k int, ts timestamp, kind string, value double"


def add(spark, folder, rows):
    """Rows as one more file of a stream's folder."""
    df = spark.createDataFrame(rows, "k int, ts string, kind string, value double")
    df.select("k", F.col("ts").cast("timestamp").alias("ts"), "kind", "value").coalesce(1).write.mode("append").parquet(str(folder))


def watch(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def killed(monkeypatch, at):
    """The sink writes epoch `at` and then dies, once."""
    real, left = results.commit, [1]

    def commit(batch, folder, epoch):
        real(batch, folder, epoch)
        if epoch == at and left:
            left.pop()
            raise RuntimeError("killed")

    monkeypatch.setattr(results, "commit", commit)


def test_once_over_kills_and_restarts(spark, tmp_path, monkeypatch):
    for rows in ([(1, "2024-01-01", "a", 1.0), (2, "2020-01-01", "b", 3.0)], [(1, "2023-01-01", "a", 2.0), (3, None, None, None), (None, "2024-01-01", "n", 1.0)], [(2, "2019-01-01", "c", 4.0), (4, "2024-06-01", "c", 4.0)]):
        add(spark, tmp_path / "in", rows)
    home = str(tmp_path / "home")
    killed(monkeypatch, 1)
    with pytest.raises(Exception, match="killed"):
        results.append_once(watch(spark, tmp_path / "in"), "k", home)
    got = results.append_once(watch(spark, tmp_path / "in"), "k", home)
    ids = lambda df: sorted((r.k for r in df.collect()), key=str)
    assert ids(got) == [1, 2, 3, 4, None] and {r.epoch for r in got.collect()} == {0, 1, 2}  # the killed batch has its own place again
    add(spark, tmp_path / "in", [(1, "2030-01-01", "a", 1.0), (5, "2030-01-01", "a", 1.0)])
    got = results.append_once(watch(spark, tmp_path / "in"), "k", home)
    assert ids(got) == [1, 2, 3, 4, 5, None]
    assert ids(got.where("epoch = 3")) == [5]  # one more batch: what was read isn't read again
    assert results.append_once(watch(spark, tmp_path / "in"), "k", home).count() == 6


def test_ledger_refuses_and_resumes(spark, tmp_path, monkeypatch):
    add(spark, tmp_path / "in", [(1, "2024-01-02", "a", 2.0), (1, "2024-01-01", "a", 1.0), (2, "2024-01-01", "b", 5.0), (2, "2024-01-03", "c", 6.0), (3, None, None, None)])
    add(spark, tmp_path / "in", [(1, "2024-01-03", "x", 9.0), (2, "2023-01-01", "c", 7.0), (2, "2024-02-01", "b", 8.0)])
    home = str(tmp_path / "home")
    go = lambda: results.stream_ledger(watch(spark, tmp_path / "in"), "k", "ts", "kind", "k", home)
    killed(monkeypatch, 1)
    with pytest.raises(Exception, match="killed"):
        go()
    rows = go()
    first = rows.orderBy("epoch").first()
    now = lambda df: {r.request: (r.print, r.value, r.accepted, r.refused) for r in results.entries(df).collect()}
    both = {1: ("a", 2.0, 2, 1), 2: ("b", 8.0, 2, 2), 3: ("", None, 1, 0)}
    other = {1: ("x", 9.0, 1, 2), 2: ("c", 7.0, 2, 2), 3: ("", None, 1, 0)}
    if now(rows) != both:  # the order of the files is Spark's
        assert now(rows)[1] == other[1]
        return
    assert first.epoch == 0 and {(r.request, r.print, r.n) for r in rows.where("kind = 'refused'").collect()} == {(2, "c", 1), (1, "x", 1)}
    add(spark, tmp_path / "in", [(1, "2025-01-01", "x", 9.0), (4, "2025-01-01", "d", 4.0), (1, "2020-01-01", "a", 0.0)])
    rows = go()
    assert now(rows) == both | {1: ("a", 2.0, 3, 2), 4: ("d", 4.0, 1, 0)}  # an older entry of the same request counts, its value doesn't
    assert {r.epoch for r in rows.where("request = 4").collect()} == {2} and rows.where("epoch = 2").count() == 3  # only new keys and those of the batch
    assert go().count() == rows.count()
