"""The prefix trie, collocations and shards against brute-force versions, with nulls, ties, repeats, hot groups and odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tallywright.llm")
from tallywright.llm import conversation_trie as trie  # noqa: E402
from tallywright.llm import phrases, sharding  # noqa: E402


# op11
def brute_trie(rows, rebuild):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    old = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    new = {}
    for c, x in old.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        new[c] = old.get(base, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in new.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(new[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(df, rebuild, **more):
    placed = trie.turns(df)
    return {tuple(r) for r in trie.prefix_trie((trie.rebuilt if rebuild else trie.as_they_are)(placed), **more).collect()}


@pytest.mark.parametrize(("rebuild", "more"), [(True, {}), (True, {"shard_rows": 20, "segment": 3}), (False, {"shard_rows": 15, "segment": 2})])
def test_trie(spark, rebuild, more, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "LIST", 3)
    rng = random.Random(3)
    texts = ["hi", "yes", "", None, "é" * 9]
    rows = []
    for c in [*range(-6, 30), 1000]:
        start = [("u", "hot"), ("a", "same")] if c % 3 == 0 else []  # a third share their beginning
        more_turns = [(rng.choice(["u", "a", None]), rng.choice(texts)) for _ in range(rng.randint(0, 12))]
        rows += [(c, t if t else None, *x) for t, x in enumerate(start + more_turns)]
    rows += [(40 + c, t, "u", f"copy {t}") for c in range(12) for t in range(10)]  # copies
    rows += [(60, t % 2, "u", "tie") for t in range(5)] + [(None, 1, "u", "nobody"), (61, None, None, None), (61, None, "b", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "conv_id long, turn int, role string, text string, pos int, n int").repartition(3)
    assert trie_of(df, rebuild, **more) == brute_trie(rows, rebuild)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert trie_of(spark.createDataFrame([], schema), True) == set()
    rows = [(7, t, "u", f"t{t}") for t in range(300)] + [(8, t, "u", f"t{t}") for t in range(250)]
    got = trie_of(spark.createDataFrame(rows, schema), False, segment=16)
    assert got == brute_trie(rows, False) and len(got) == 301


def test_perfect_hash_has_no_gaps():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 62), 1 << 62, (2, 20_000))
    a[:5000] = 17  # keys that share a word
    table = trie.PerfectHash(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(20_000))
    with pytest.raises(ValueError):
        trie.PerfectHash(np.array([1, 1]), np.array([2, 2]))


def test_a_false_digest_is_found():
    import pandas as pd

    rows = pd.DataFrame({"shard": 0, "conv_id": [1, 1, 2, 2, 2], "seg": 0, "pos": [0, 1, 0, 1, 2], "m1": [0, 5, 0, 1, 4], "m2": [0, 6, 0, 2, 4], "n_bytes": [0, 1, 0, 1, 1], "last": False, "edge": False})
    with pytest.raises(ValueError, match="one digest"):  # 1 ^ 4 = 5 and 2 ^ 4 = 6: two prefixes of different depth
        trie.node_table(rows)


# op12
def brute_phrases(rows, least=30, drop=80, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(end, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, p), a in c.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    held[lang, p[i:j]] = max(held[lang, p[i:j]], a)
    out = defaultdict(list)
    for (lang, p), a in c.items():
        if 100 * held[lang, p] < drop * a:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, left, right, total[lang], -score) for lang, x in out.items() for i, (score, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


@pytest.mark.parametrize(("least", "block"), [(30, 8_000_000), (3, 300)])
def test_collocations(spark, least, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rng = random.Random(4)
    words = ["the", "the", "the", "New", "york", "é\x01", "a\x00b", "x", "\x02", "ça", "the\xa0end"]
    rows = [(rng.choice(["en", "en", "en", None, "de"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t ", ". ", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", "in New York City hall"), ("en", "x x x x x x")] * 40 + [("en", None), (None, ""), ("fr", "long words here " * 4000), ("de", " . ! ")]
    df = spark.createDataFrame([(i, t, g, 1, 2) for i, (g, t) in enumerate(rows)], "doc_id int, text string, lang string, n int, f int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least=least).collect()]
    want = brute_phrases(rows, least)
    assert set(got) == want and len(got) == len(want)
    few = {tuple(r) for r in phrases.collocations(df, least=least, top=5).collect()}
    assert few == {r for r in want if r[1] <= 5}


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id int, text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "one two", None)], "doc_id int, text string, lang string")).count() == 0


def test_the_filter_only_saves_work():
    """Each phrase whose two parts are in the filter is counted, and a full filter leaves nothing out."""
    block = phrases.Block([b"a b A b c. a b", b"b c a b"], "en")
    full, none = np.full(512, 255, dtype="uint8"), np.zeros(512, dtype="uint8")
    words, keys, much = block.phrases(2, *block.parted(2, full))
    assert dict(zip(map(tuple, words), much.tolist(), strict=True)) == {("a", "b"): 4, ("b", "a"): 1, ("b", "c"): 2, ("c", "a"): 1}
    assert set(keys.tolist()) == set(block.begins(2)[1].tolist()) and len(block.parted(3, none)[0]) == 0
    only = none.copy()  # the words a and b
    for k in block.hashed[[block.names.index(w) for w in (b"a", b"b")]]:
        at = int(phrases.place(np.array([k], dtype="uint64"), 4096)[0])
        only[at >> 3] |= 1 << (at & 7)
    assert {tuple(w) for w in block.phrases(2, *block.parted(2, only))[0]} == {("a", "b"), ("b", "a")}


# op13
def brute_shards(rows, shards=8, tolerance=0.01):
    """rows: (doc_id, text), no two equal; the edges by the rule of the docstring, from a sorted list."""
    part = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    items = sorted((part(t or ""), part("" if i is None else str(i)), i, len((t or "").encode()) + 1) for i, t in rows)
    total, edges = sum(x[3] for x in items), []
    for i in range(1, shards):
        target, below, at = total * i // shards, 0, 0
        while below + items[at][3] <= target:
            below += items[at][3]
            at += 1
        k1, k2 = items[at][:2]
        for p in (0, 1):
            for bits in range(12, 61, 8):
                s = 60 - bits
                lo = [x for x in items if (x[0] >> s < k1 >> s if p == 0 else x[0] < k1 or x[0] == k1 and x[1] >> s < k2 >> s)]
                hi = [x for x in items if (x[0] >> s <= k1 >> s if p == 0 else x[0] < k1 or x[0] == k1 and x[1] >> s <= k2 >> s)]
                best = min(sum(x[3] for x in lo), sum(x[3] for x in hi), key=lambda b: abs(b - target))
                if abs(best - target) <= int(total / shards * tolerance):
                    break
            else:
                continue
            break
        edges.append(best)
    out, below, slots = {}, 0, Counter()
    for _, _, i, size in items:
        s = sum(e <= below for e in edges)
        out[i] = (size, s, slots[s])
        slots[s] += 1
        below += size
    return out


@pytest.mark.parametrize("pieces", [1, 3, None])
def test_shards(spark, pieces):
    rng = random.Random(6)
    rows = [(i, "w" * rng.randint(0, 400)) for i in range(400)] + [(1000 + i, "hot text " * 20) for i in range(200)] + [(2000, "long " * 9000), (None, "no id"), (2001, None), (2002, "é")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, shard string, piece int").repartition(3)
    got = sharding.shard(df, pieces=pieces)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    text = dict(rows)
    assert {r.doc_id: (r["size"], r.shard, r.slot) for r in got} == brute_shards(rows) and len(got) == len(rows)
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)


def test_shards_are_near_equal_and_keep_copies_together(spark):
    rows = [(i, f"text {i % 1500} " * 20) for i in range(6000)] + [(i, "the same for a third of all " * 9) for i in range(6000, 9000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[rows[r.doc_id][1]].add(r.shard)
    even = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(b - even) <= 0.021 * even for b in size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sum(len(s) > 1 for s in of.values()) <= 3 and len(of[rows[-1][1]]) > 2  # the hot text fills several


def test_shards_of_repeated_rows_and_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string"
    assert sharding.shard(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "again and again")] * 500 + [(2, "b")], schema).repartition(5)
    got = sharding.shard(df, 4).collect()
    assert len(got) == 501 and {n for n in Counter(r.shard for r in got).values()} <= {124, 125, 126}
    assert len({(r.shard, r.slot) for r in got}) == 501
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 501 and back.where("text = 'b'").count() == 1 and set(back.columns) == {"doc_id", "text", "size", "text_crc32", "law", "slot", "grown_shard", "shard"}
