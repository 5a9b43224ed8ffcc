"""What the operators do inside: the genetic steps, the merge, thresholds, folds and spans; and inputs that once gave wrong rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
from tallywright.llm import common, exact_dedup, line_dedup, packing, pii, quality_rules, toxicity  # noqa: E402
from tallywright.llm.queries import tokenizer  # noqa: E402


# op1
def test_crossover_finds_what_best_fit_misses():
    """Best-fit of the sorted order needs one bin more than crossing a few such packings does."""
    rng = random.Random(6)
    better = 0
    for seed in range(30):
        lengths = []
        for _ in range(12):  # bins that can be filled exactly, with three or four parts
            cuts = sorted(rng.sample(range(1, 100), rng.choice([2, 3])))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        lengths.sort(reverse=True)
        plain = packing.evolve(lengths, [], 100, 4, 0, random.Random(seed))
        bred = packing.evolve(lengths, [], 100, 8, 400, random.Random(seed))
        assert sorted(i for b in bred.bins for i in b) == list(range(len(lengths))) and max(bred.fill) <= 100
        assert len(bred.bins) <= len(plain.bins)
        better += len(bred.bins) < len(plain.bins)
    assert better  # otherwise the genetic steps would be for nothing


def test_elites_migrate_between_islands(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "materialize", lambda df, name: seen.append(name) or common.materialize(df, name))
    items = spark.createDataFrame([(0, i, 300 + i * 37 % 900) for i in range(60)], "shard long, item long, length long")
    got = packing.islands(items, 2048, 1, 3, 3, 4, 8).collect()
    assert sorted(r.item for r in got) == list(range(60)) and seen == ["islands"]
    fill = defaultdict(int)
    for r in got:
        fill[r.bin] += r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)


@pytest.mark.parametrize("parts", [1, 3])
def test_pieces_of_rows_that_look_alike(spark, parts):
    rows = [(1, "the cat"), (1, "the dog"), (None, "one two"), (None, "six ten"), (5, "again"), (5, "again"), (7, "long " * 5000), (7, "more " * 5000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), tokenizer("byte_bpe_50k.json")).collect()
    assert sum(r.piece == 0 for r in got) == len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


# op2
def test_spans_of_the_query(spark):
    rng = random.Random(5)
    bits = ["joe@x.org", "10.0.0.1", "4111 1111 1111 1111", "+49 30 123456", "plus four nine one five one two three four five six", "joe [at] x [dot] org", "１９２.１６８.０.１", " ", " and ", "é"]
    texts = ["".join(rng.choice(bits) + " " for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None, "", "1.2.3.4 " * 3000]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, r = text or "", got[i]
        base, added = pii.spans(text)
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and len(spans) == len(base) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])) and {(pii.KINDS[k], a, b) for k, a, b in base} <= set(spans)
        for k, a, b in added:
            assert not any(k == k2 and a < b2 and a2 < b for k2, a2, b2 in base)  # brute force
    assert got[len(texts) - 1].n_ip == 3000


# op4
def test_the_sample_is_bounded_and_names_may_clash(spark):
    rows = [(i % 2, f"text {i} idiot" if i % 4 == 0 else f"text {i}", 5, 6, "x", 7) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, _id int, key string, fold int")
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(docs, labels, toxicity.CATEGORIES, 1, 3, "doc_id", "text").count() == 1
    assert toxicity.toxicity(docs, labels, most=1).count() == 500


def test_features_are_chosen_without_the_fold(spark):
    rows = [(i, i % 3, int(i < 12), ["bad"] if i < 12 and i % 3 == 0 else ["word"]) for i in range(60)]
    sample = spark.createDataFrame(rows, "key int, fold int, toxic int, f array<string>")
    lists = toxicity.vocabularies(sample, ["toxic"], 3, 2, 3.0, 10)
    assert "bad" in lists[-1] and "bad" not in lists[0] and "bad" in lists[1]  # all that tells is in fold 0


def test_equal_texts_share_a_fold(spark):
    docs = spark.createDataFrame([(i, f"same {i % 5}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    folds = defaultdict(set)
    for r in toxicity.labelled(docs, labels, toxicity.CATEGORIES, 100, 3, "doc_id", "text").collect():
        folds[r.text].add(r.fold)
    assert all(len(f) == 1 for f in folds.values()) and len(folds) == 5


# op5
def test_each_round_merges_sorted_runs(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "shuffle_partitions", lambda _: 9)
    docs = spark.createDataFrame([(i, f"t{i % 50}") for i in range(300)], "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_dedup(docs, arity=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 4 and "Python" not in plan  # two rounds, each with a sort in front of its aggregate
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {(i, 250 + i % 50, 6) for i in range(300)}
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs, keep="min").collect()} == set(range(50))
    nulls = spark.createDataFrame([(None, "a"), (2, "a"), (None, "b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(nulls, keep="min").collect()} == {(None, 2), (2, 2), (None, None)}


# op9
def line_rows(df):
    return sorted(map(str, line_dedup.line_dedup(df).collect()))


def test_lines_of_rows_that_share_an_identifier(spark):
    a = "one two three four five six"
    rows = [(None, a), (None, a.replace("three", "other")), (4, a.replace("six", "last")), (4, "x\n" + a), (4, a.replace("one", "first") + "\n" + "y y y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two, three = (line_rows(df.repartition(n)) for n in (1, 2, 5))
    assert one == two == three and sum("near" in r for r in one) >= 2
    merged = line_rows(df.coalesce(1))
    assert merged == one
    from unittest.mock import patch

    def joined(*args, broadcast_rows=100_000, real=line_dedup.line_dedup):
        return real(*args, broadcast_rows=0)

    with patch.object(line_dedup, "line_dedup", joined):  # nothing is broadcast
        assert line_rows(df) == one


def test_lines_by_document(spark):
    text = "a b c\n\na b c\nother words here now yes\nother words there now yes\n"
    r = line_dedup.by_document(line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, None), (3, "a b c")], "doc_id long, text string"))).collect()
    got = {x.doc_id: (x.n_lines, x.n_exact, x.n_near, x.kept_chars) for x in r}
    assert got == {1: (4, 1, 1, 5 + 24), 3: (1, 1, 0, 0)}
    hashes = spark.createDataFrame([(2,), (4,), (0,)], "line int").selectExpr("line", "xxhash64(line) as h").collect()
    of = {x.line: x.h for x in hashes}
    assert {x.doc_id: x.dropped_hash for x in r} == {1: of[2] ^ of[4], 3: of[0]}


# op10
def test_thresholds_are_quantiles_of_the_group(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(400):
        lang, source = ["en", "de"][i % 2], ["s1", "s2"][i // 200]
        w = [word(rng.randint(3, 6 if lang == "en" else 9)) for _ in range(rng.randint(20, 60))]
        if i % 20 == 0:
            w[::4] = ["#" * 5] * len(w[::4])
        rows.append((i, " ".join(w), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    measured = [r for r in quality_rules.measure(docs).collect() if not r.base_failed]
    limits = {(r.lang, r.source): r for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.measure(docs)), 50).collect()}
    for (lang, source), r in limits.items():
        for m, (lo, hi, fence) in quality_rules.METRICS.items():
            xs = sorted(x[m] for x in measured if (x.lang, x.source) == (lang, source))
            at = lambda q, xs=xs: xs[max(0, -(-int(q * len(xs) * 1000) // 1000) - 1)]
            want = at(hi) + fence * (at(hi) - at(0.5))
            assert r[f"{m}_high"] == pytest.approx(want, rel=0.08, abs=1e-9)
            if lo:
                assert r[f"{m}_low"] == pytest.approx(at(lo) - fence * (at(0.5) - at(lo)), rel=0.12)
    assert len({r.mean_word_chars_high for r in limits.values()}) > 1
    for r in quality_rules.quality_rules(docs).collect():
        t = limits[rows[r.doc_id][2], rows[r.doc_id][3]]
        m = next((x for x in measured if x.doc_id == r.doc_id), None)
        assert r.kept == (m is not None and all(m[k] <= t[f"{k}_high"] and (q[0] is None or m[k] >= t[f"{k}_low"]) for k, q in quality_rules.METRICS.items()))
    assert not re.search("0\\.02|2\\.0", str(quality_rules.METRICS))


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, " ".join(["word" * (1 + i % 3)] * 30), "en", f"s{i % 2}") for i in range(60)], "doc_id long, text string, lang string, source string")
    whole = quality_rules.sketches(quality_rules.measure(docs))
    parts = quality_rules.sketches(quality_rules.measure(docs.where("doc_id < 20"))).unionByName(quality_rules.sketches(quality_rules.measure(docs.where("doc_id >= 20"))))
    of = lambda df: {(r.metric, r.lo, r.mid, r.hi) for r in quality_rules.quantiles(df, ["lang"]).collect()}
    assert of(whole) == of(parts)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch(Session)
