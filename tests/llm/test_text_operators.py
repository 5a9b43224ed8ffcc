"""Each operator against a brute-force version, on a small fixture with the awkward cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import combinations

import pytest

from tallywright.llm import exact_dedup, line_dedup, lm_score, mixing, packing, pii, quality_rules, simhash_dedup, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, run int, node int, component long, toxic int, _id long, row int, item int, block int, key int, lines int, tokens int"
EXTRA = (1, True, 5, 1, 1, 2, 7, 8, 9, 10, 11, 12, 13, 14)


def make():
    rng = random.Random(4)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "ñé"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [text(rng.randint(1, 120)) for _ in range(60)]
    texts += [None, "", " \t\n", texts[0], texts[0], texts[1] + " x", texts[2].replace(" ", "\n"), text(6000), "a" * 3000, "日本語 \U0001f600 <|endoftext|>  x\r\ny", texts[3] + "\n" + texts[3], "\n".join([texts[4]] * 3)]
    long = text(200).split(" ")
    texts += [" ".join(long), " ".join([*long[:90], "changed", *long[91:]]), " ".join(long[:50] + long[51:])]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "src1", "src2", "src3"][i % 4], *EXTRA) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no identifier here", "en", "src1", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    by = defaultdict(list)
    for r in make():
        by[r[1] or ""].append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(make())
    of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in got:
        ids = [i for i in of[r.text_sha256] if i is not None]
        assert r.keep_id == max(ids, default=None) and r.group_size == len(of[r.text_sha256]) and r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_token_counts(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = {r[0]: r[1] or "" for r in make()}
    for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect():
        assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), len(sp.encode(text[r.doc_id])))
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = {r[0]: r[1] or "" for r in make()}
    got = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    bins, pieces = defaultdict(list), defaultdict(dict)
    for r in got:
        bins[r.sequence_id].append(r)
        pieces[r.doc_id][r.piece] = r
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for d, ps in pieces.items():
        ids = [*tok.encode(text[d], add_special_tokens=False).ids, 0]
        assert sum(p.length for p in ps.values()) == len(ids)
        for k, p in ps.items():
            assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[p.start : p.start + p.length])) == p.ids_crc32 and (k == 0 or p.length == 2048)
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_packing_of_null_identifiers(spark):
    d = spark.createDataFrame([(None, "one two three"), (None, "two three one"), (None, "three one two"), (7, "one two three"), (7, "three two one")], "doc_id long, text string")
    got = packing.pack(d, P.path("byte_bpe_50k.json")).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5 and len({(r.doc_id, r.ids_crc32) for r in got}) == 5


@pytest.mark.parametrize("radius", [4])
def test_simhash(docs, empty, radius):
    fp = {r[0]: simhash_dedup.fingerprint(r[1] or "", 4) for r in make() if r[0] is not None}
    group = {i: i for i in fp}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in fp:
        for j in fp:
            if ((fp[i] ^ fp[j]) & ((1 << 64) - 1)).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    for r in simhash_dedup.simhash_dedup(docs, radius=radius).collect():
        if r.doc_id is not None:
            assert r.component_id == root(r.doc_id) and r.fingerprint == f"{fp[r.doc_id] & ((1 << 64) - 1):016x}"
    assert simhash_dedup.simhash_dedup(empty).count() == 0


def test_covering_masks():
    rng = random.Random(1)
    for radius in (1, 4, 5):
        ms = simhash_dedup.masks(radius)
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & d == 0 for m in ms)


def test_hot_buckets_give_the_same_components(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 5)
    fps = sorted({int(b) ^ int(sum(1 << int(k) for k in rng.integers(0, 60, 3))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tallywright.llm.components import connected_components

    a, b = ({r.node: r.component for r in connected_components(simhash_dedup.links(df, 4, bucket)).collect()} for bucket in (4096, 8))
    assert a == b and a


def jaccard_groups(texts, least):
    """Brute force: the least index of each text's component."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 5 * least * len(sets[i] | sets[j]) - 1e-9 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_near_copies_are_all_found(spark, docs, empty):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(200)]
    texts = [t or "" for i, t, *_ in make() if i is not None][:-1]
    for n in (5, 9, 20, 60, 110, 150, 200):
        for _ in range(12):
            base = rng.choices(vocab, k=n)
            texts.append(" ".join(base))
            for edits in (1, 2, 3, 4):
                new = list(base)
                for _ in range(edits * n // 60 + 1):
                    new[rng.randrange(n)] = rng.choice(vocab)
                texts.append(" ".join(new))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = jaccard_groups(texts, 0.8)
    got = simhash_dedup.near_copies(d).collect()
    of = {r.doc_id: r.component_id for r in got}
    copies = [i for i, g in enumerate(group) if g != i]
    found = [i for i in copies if of[i] != i]
    assert all(group[i] == group[of[i]] for i in of)  # no text joins another group
    assert len(found) >= 0.9 * len(copies)  # recall of the tables
    assert {r.doc_id for r in got if r.kept} == set(of.values())
    sets = simhash_dedup.near_copies(docs)
    assert sets.count() == len(make()) and sets.where("kept").count() < len(make()) and simhash_dedup.near_copies(empty).count() == 0


def test_recall_in_each_band_of_similarity(spark):
    """150 pairs a band, of 13 to 150 words, with words changed here and there, in one passage, or added at an end."""
    rng = random.Random(12)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    bands, texts = {(0.8, 0.85): [], (0.85, 0.9): [], (0.9, 1.0): []}, []
    while min(map(len, bands.values())) < 150:
        n = rng.choice([13, 16, 30, 45, 60, 100, 150])
        base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        new, k, at = list(base), rng.randint(1, max(1, n // 9)), rng.randrange(n)
        how = rng.randrange(3)
        for i in {0: [rng.randrange(n) for _ in range(max(1, k // 4))], 1: range(at, min(n, at + k)), 2: []}[how]:
            new[i] = f"x{rng.randrange(10**9)}"
        if how == 2:
            new += [f"x{rng.randrange(10**9)}" for _ in range(k)]
        a, b = sets(base), sets(new)
        j = len(a & b) / len(a | b)
        for (lo, hi), held in bands.items():
            if lo <= j < hi and len(held) < 150:
                held.append(len(texts))
                texts += [base, new]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(d).collect()}
    for held in bands.values():
        assert sum(of[i] == of[i + 1] for i in held) >= 0.9 * len(held)


@pytest.mark.parametrize("small", [4, 1000])
def test_a_large_group_of_loose_copies(spark, monkeypatch, small):
    """Variants of one text of which some are near copies and most are not: large buckets are compared in tasks, and the result is that of all pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(140):
        new = list(base)
        for i in rng.sample(range(90), rng.choice([1, 2, 3])):
            new[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(new))
    pairs = simhash_dedup.block_pairs
    monkeypatch.setattr(simhash_dedup, "block_pairs", lambda s, c, x: pairs(s, c, x, block=16, small=small))
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    group = jaccard_groups(texts, 0.8)
    assert [got[i] for i in range(len(texts))] == group and len(set(group)) > 3


def test_masks_of_symbols():
    ms = simhash_dedup.symbol_masks()
    assert ms.shape == (63, 16) and ms.sum(axis=1).min() >= 6
    for unlike in combinations(range(16), 5):  # some mask keeps none of them
        assert (ms[:, unlike].sum(axis=1) == 0).any()


@pytest.mark.parametrize("few", [100_000, 0])
def test_large_buckets_are_dealt_out(spark, monkeypatch, few):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(60)] + [" ".join(f"y{k}{i}" for i in range(30)) for k in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(d).collect()}
    real = simhash_dedup.buckets
    monkeypatch.setattr(simhash_dedup, "buckets", lambda c: real(c, bucket=16, few=few))
    pairs = simhash_dedup.block_pairs
    monkeypatch.setattr(simhash_dedup, "block_pairs", lambda s, c, x: pairs(s, c, x, block=8, small=4))
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_copies(d).collect()} == want == {i: 0 if i < 60 else i for i in range(90)}


def test_links_are_checked_before_they_are_thinned(spark):
    base = [f"w{i}" for i in range(100)]
    mixed = random.Random(1).sample(base, 100)
    texts = [mixed, base, [*base[:50], "changed", *base[51:]], mixed[::-1]]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = simhash_dedup.near_copies(d)
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 1, 2: 1, 3: 3}  # equal words aren't links, and the least of a bucket doesn't stand for it


def test_null_identifiers_have_components(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f g h i"), (None, "")], "doc_id long, text string")
    assert simhash_dedup.simhash_dedup(d).count() == 4
    got = simhash_dedup.near_copies(d).collect()
    assert len({(r.doc_id, r.text_sha256) for r in got if r.kept}) == 3 and len(got) == 4


def test_line_dedup(docs, empty):
    lines = sorted({((-1 if r[0] is None else r[0]), i, x) for r in make() for i, x in enumerate((r[1] or "").split("\n")) if x.encode().split()})
    words = lambda x: [w.decode() for w in x.encode().split()]

    def near(a, b):
        a, b = sorted((words(a), words(b)), key=len)
        if len(a) < 5 or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want, first = {}, {}
    for d, i, x in lines:
        if x in first:
            want[d, i] = ("exact", first[x])
        else:
            first[x] = (d, i)
    distinct = sorted((v, k) for k, v in first.items())
    for at, x in distinct:
        for before, y in distinct:
            if before < at and near(x, y):
                want[at] = ("near", before)
                break
    got = {(-1 if r.doc_id is None else r.doc_id, r.line): (r.dropped, (r.earlier_doc, r.earlier_line)) for r in line_dedup.line_dedup(docs).where("dropped is not null").collect()}
    assert got == want and {k for k, _ in want.values()} == {"exact", "near"}
    assert line_dedup.line_dedup(empty).count() == 0


def test_quality_counts(docs, empty):
    text = {r[0]: r[1] or "" for r in make()}
    for r in quality_rules.quality_rules(docs).collect():
        w = [x.decode() for x in text[r.doc_id].encode().split()]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
        lines = [x for x in text[r.doc_id].split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text[r.doc_id].count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_lm_score(docs, empty):
    import math
    from collections import Counter

    rows = make()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = Counter(w for r in rows if not held(r[0]) for w in [*(r[1] or "").encode().lower().split(), b"\n"])
    n, v = sum(count.values()), len(count)
    base = {r[0]: sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(r[1] or "").encode().lower().split(), b"\n"]) for r in rows}
    got = lm_score.lm_score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id) and r.train_tokens == n and r.base_score == pytest.approx(base[r.doc_id]) and r.score <= 0
    assert lm_score.lm_score(empty).count() == 0


def naive_tree(texts, depth, least, evidence, inertia):
    """Brute force: next-byte counts of every context in a dict, and a function giving log10 P(byte | bytes before it)."""
    import math

    symbols = lambda t: b"\n" + b" ".join(t.encode().lower().split()) + b"\n"  # noqa: E731  the end also stands before a text
    counts = defaultdict(lambda: defaultdict(int))
    for t in texts:
        s = symbols(t)
        for i in range(1, len(s)):
            for k in range(min(i, depth) + 1):
                counts[s[i - k : i]][s[i]] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}
    kept = {c for c in counts if c and total[c] >= least and total[c[1:]] >= least and 2 * sum(n * math.log(n * total[c[1:]] / (total[c] * counts[c[1:]][x])) for x, n in counts[c].items()) > evidence * len(counts[c]) * math.log(total[c])}

    def share(context, x):
        if not context:
            return (counts[b""][x] + 0.5) / (total.get(b"", 0) + 128)
        below = share(context[1:], x)
        return (counts[context][x] + inertia * below) / (total[context] + inertia) if context in kept else below

    def score(t):
        s = symbols(t)
        return sum(math.log10(share(s[max(0, i - depth) : i], s[i])) for i in range(1, len(s)))

    return score, kept


def test_scores_are_those_of_a_brute_force_tree(spark, docs):
    rows = [r for r in make() if r[1] != "a" * 3000]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    texts = {r[0]: (r[1] or "")[:2000] for r in rows}
    d = spark.createDataFrame([(r[0], texts[r[0]]) for r in rows], "doc_id long, text string").repartition(2)
    score, kept = naive_tree([texts[r[0]] for r in rows if not held(r[0])], lm_score.DEPTH, 4, 0.5, 16.0)
    got = lm_score.lm_score(d, least_count=4, block_bytes=3000).collect()
    assert len(got) == len(rows) and len(kept) > 100
    for r in got:
        assert r.score == pytest.approx(score(texts[r.doc_id]), rel=1e-4)


def test_states_sum_to_one_and_long_texts_have_no_seams(spark, docs, monkeypatch):
    import numpy as np

    bodies = lm_score.cut(docs, lm_score.F.lit(False), 1000, "doc_id", "text")
    whole = {r.code: r.n for r in lm_score.window_counts(bodies).collect()}
    rows = lm_score.contexts(lm_score.window_counts(bodies), 1e-3, 2, 0.1)
    m = lm_score.Model(rows, 4.0)
    assert np.allclose((10.0 ** m.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    parts = [b"there once " * 200 + b"\n", b"\n", b"an on er\n", "日本 x\n".encode()]
    assert len(m.logs_of(parts)) == sum(map(len, parts))
    assert np.allclose(m.logs_of(parts)[-len(parts[3]) :], m.logs_of([parts[3]]))
    monkeypatch.setattr(lm_score, "SORTED", 64)
    cut_up = [p for r in bodies.collect() for p in lm_score.stretches(bytes(r.body), 64)]
    codes, n = np.unique(lm_score.windows(cut_up), return_counts=True)
    assert dict(zip(codes.tolist(), n.tolist(), strict=True)) == whole


def filled(nodes, budget):
    """Brute force: shares out a budget by weight among {name: (capacity, weight)}, what one can't take going to the others."""
    target, open_ = {}, dict(nodes)
    while open_:
        level = budget / sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= w * level}
        if not full:
            return target | {k: w * level for k, (_, w) in open_.items()}
        target |= full
        budget -= sum(full.values())
        open_ = {k: x for k, x in open_.items() if k not in full}
    return target


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 2), (0.8, 1), (1.7, 2)])
def test_mixing(docs, empty, share, epochs):
    import re

    import xxhash

    leaf, copies = {}, defaultdict(int)
    for d, t, lang, source, *_ in make():
        number = re.search("[0-9]{1,9}", source or "")
        at = (f"d{int(number[0]) % 4 if number else 0}", lang or "?", source or "?")
        h = xxhash.xxh64_intdigest(t or "", 42)
        doc = (d, len((t or "").encode().split()), h - (1 << 64) if h >> 63 else h)
        leaf.setdefault(at, set()).add(doc)
        copies[at, doc] += 1
    size = {at: sum(n * copies[at, (d, n, h)] for d, n, h in ds) for at, ds in leaf.items()}
    budgets = {(): min(share * sum(size.values()), epochs * sum(size.values()))}
    for i, level in enumerate(mixing.LEVELS):
        for up in {at[:i] for at in size}:
            weight = lambda name, level=level: mixing.WEIGHTS[level].get(name, mixing.WEIGHTS[level]["*"])
            nodes = {at[: i + 1]: (0, 0) for at in size if at[:i] == up}
            nodes = {n: (float(epochs * sum(v for at, v in size.items() if at[: i + 1] == n)), weight(n[i])) for n in nodes}
            budgets |= filled(nodes, budgets[up])
    want = {}
    for at, ds in leaf.items():
        whole = int(budgets[at] // size[at] + 1e-9) if size[at] else 0
        rest, before = budgets[at] - whole * size[at], 0
        for d, n, h in sorted(ds, key=lambda x: (hashlib.md5(f"17:{whole}:{'' if x[0] is None else x[0]}:{x[2]}".encode()).hexdigest(), x[1])):
            took = whole * copies[at, (d, n, h)]
            for _ in range(copies[at, (d, n, h)]):
                took += before < rest - 1e-6
                before += n
            if took:
                want[at, d, n, h] = took
    got = {((r.domain, r.lang, r.source), r.doc_id, r.tokens, r.text_hash): r.copies for r in mixing.mix(docs, share=share, epochs=epochs).collect()}
    assert got == want
    assert mixing.mix(empty).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 100), ("a", "y", "s3", 100), ("b", "x", "s4", 1000)], "domain string, lang string, source string, tokens long")
    even = {"domain": {"*": 1.0}, "lang": {"*": 1.0}, "source": {"*": 1.0}}
    got = {r.source: round(r.target, 6) for r in mixing.budgets(leaves, even, 200 / 1210, 1).collect()}
    assert got == {"s1": 10, "s2": 40, "s3": 50, "s4": 100}
    got = {r.source: round(r.target, 6) for r in mixing.budgets(leaves, even, 800 / 1210, 1).collect()}
    assert got == {"s1": 10, "s2": 100, "s3": 100, "s4": 590}


DISGUISED = [
    ("write to john.doe [at] mail [dot] example [dot] com now", "email"),
    ("write to john.doe at mail dot example dot com now", "email"),
    ("joe＠exаmple．com is it", "email"),
    ("call plus four nine one five one two three four five six seven eight today", "phone"),
    ("card four one one one 1111 1111 one one one one ok", "card"),
    ("host 10 [dot] 0 [dot] 12 [dot] 7 up", "ip"),
    ("host １９２.１６８.０.１ up", "ip"),
]


@pytest.mark.parametrize(("text", "kind"), DISGUISED)
def test_disguises(text, kind):
    base, added = pii.spans(text)
    assert not base and [pii.KINDS[k] for k, _, _ in added] == [kind]
    _, a, b = added[0]
    assert text[a] not in " \n" and text[b - 1] not in " \n"


@pytest.mark.parametrize(
    "number",
    [
        "Plus Four Nine One Five One Two Three Four Five Six",
        "PLUS FOUR NINE ONE FIVE ONE TWO THREE FOUR FIVE SIX",
        "plus-four-nine-one-five-one-two-three-four-five-six",
        "plus, one, two, six, one, two, six, one, two, six",
        "plus\none\ntwo\nsix\none\ntwo\nsix\none\ntwo\nsix",
        "plus neun acht sechs fünf acht neun sechs fünf acht neun",
        "plus cinq huit neuf cinq huit neuf un deux cinq huit",
        "plus cinco ocho nueve cinco ocho nueve uno dos cinco ocho",
    ],
)
def test_spelled_numbers_in_any_form(number):
    text = f"call {number} today"
    base, added = pii.spans(text)
    assert not base and [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [("phone", number)]


def test_pii_base(docs, empty, spark):
    import re

    rng = random.Random(2)
    alphabet = ["a.b@c.d", "x@y", "@", ".", "+49 30 123456", "4111 1111 1111 1111", "1.2.3.4", "999.1.1.1", "12", "-", " ", "(", ")", "a", "é", "4111-1111-1111-1111", "5"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {0: lambda s: True, 1: lambda s: all(int(x) <= 255 for x in s.split(".")), 2: lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), 3: lambda s: 9 <= len(digits(s)) <= 15}
    for t in texts:
        assert pii.detect(t) == [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, t) if ok[k](m[0])]
    assert pii.find_pii(docs).count() == len(make()) and pii.find_pii(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join([*rng.choices(words, k=30), *(rng.sample(["idiot", "scum", "moron"], 2) if bad else [])]), bad))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows if i < 200] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.toxicity(d, labels).collect()}
    assert all(got[i] == b for i, _, b in rows if i >= 200)
    assert toxicity.toxicity(docs, labels.limit(0)).where("rejected").count() == 0 and toxicity.toxicity(empty, labels).count() == 0


def test_toxic_words_of_a_small_sample(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        bad = i % 8 == 0
        rows.append((i, " ".join([*(f"w{rng.randrange(3000)}" for _ in range(40)), *([["idiot", "scum", "moron"][i // 8 % 3]] if bad else [])]), bad))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows if i < 80] + [(10_000 + i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.toxicity(d, labels, most=100).collect()}
    assert all(got[i] == b for i, _, b in rows)  # each word is in three or four of ten toxic texts, and most labels have no text


def test_address_of_many_zeros():
    from tallywright.llm import pii

    assert pii.detect("x " + "0" * 5000 + ".0.0.1") == [(1, 2, 5008)]
