"""The stages of the corpus pipeline against brute-force versions, with the awkward rows."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, toxic int, kept boolean, row long, text_hash long"


def make():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(30, 90))) for _ in range(120)]
    for i in range(0, 120, 6):
        texts[i] += " idiot scum"
    near = texts[7].split() * 2
    texts += [" ".join(near), " ".join([*near[:20], "changed", *near[21:]]), texts[8], texts[9] + " ", None, "", " \n", "zz " * 5000]
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src1", None][i % 3], 1, 7, 1, True, 3, 5) for i, t in enumerate(texts)]
    again = rows[10]
    return [*rows, again, again, *[(None, t, "en", "src0", 1, 7, 1, True, 3, 5) for t in ("aaa", "bbb", "bbb", texts[11])], (3, "bbb", "en", "src0", 1, 7, 1, True, 3, 5), (3, "ccc ccc", "en", "src0", 1, 7, 1, True, 3, 5)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 120)] + [(None, 1, 1), (121, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, out = spark.createDataFrame(make(), SCHEMA).repartition(3), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(at)), name)
        out.append(docs)
    return out


def rows(df):
    return sorted([(-1 if r.doc_id is None else r.doc_id, "\0" if r.text is None else r.text) for r in df.collect()])


def test_columns_stay(run):
    for df in run[:-1]:
        assert df.schema.simpleString() == run[0].schema.simpleString() and df.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_toxicity_drops_the_toxic_rows_only(run):
    assert rows(run[0]) == sorted((-1 if r[0] is None else r[0], "\0" if r[1] is None else r[1]) for r in make() if "idiot" not in (r[1] or ""))


def test_exact_dedup_leaves_one_row_of_each_text(run):
    by = defaultdict(list)
    for d, t in rows(run[0]):
        by["" if t == "\0" else t].append(d)
    got = rows(run[1])
    assert sorted((d, "" if t == "\0" else t) for d, t in got) == sorted((max(ds), t) for t, ds in by.items())


def test_near_dedup_leaves_one_row_of_each_group(run):
    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    before, after = rows(run[1]), rows(run[2])
    sets = [shingles("" if t == "\0" else t) for _, t in before]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    want = {}
    for g, (d, t) in zip(group, before, strict=True):
        want[g] = min(want.get(g, (d < 0, d, t)), (d < 0, d, t))
    assert len(before) > len(after) and sorted((d, t) for _, d, t in want.values()) == after


def test_mixing_and_packing_use_what_came_before(run):
    before, after = rows(run[2]), rows(run[3])
    words = lambda rs: sum(len(t.replace("\0", "").encode().split()) for _, t in rs)
    assert set(after) <= set(before) and words(after) <= words(before) and len(after) == len(set(after))
    pieces = run[4].collect()
    assert {-1 if r.doc_id is None else r.doc_id for r in pieces if r.piece == 0} == {d for d, _ in after} and sum(r.piece == 0 for r in pieces) == len(after)
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
