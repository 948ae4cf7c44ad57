import random
import re
from collections import Counter, defaultdict

import numpy as np
from foliate.llm import minhash
from foliate.llm.textkit import Words, mix, multiset, shingles
from foliate.llm.workspace import Workspace


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    low = sum((a & b).values())
    return low / sum((a | b).values()) if a or b else 0.0


def brute_groups(rows):
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, b in bags.items():
        for s in b:
            holders[s].add(i)
    pairs = {(x, y) for s in holders.values() for x in s for y in s if x < y}
    for x, y in pairs:
        if jaccard(bags[x], bags[y]) >= 0.8:
            x, y = sorted((find(x), find(y)))
            parent[y] = x
    return {i: find(i) for i in bags}


def fixture():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)] + ["é", "über"]
    rows, n = [], 0
    for _ in range(40):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, rng.choice([" ", "\n", " \t"]).join(w)))
            n += 1
    chain = [rng.choice(vocab) for _ in range(300)]
    for i in range(12):  # each like its neighbours only
        rows.append((n, " ".join(chain[i * 12 : i * 12 + 150])))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, ""), (n + 3, " \n"), (n + 4, "a a a a a a a a a a a a"), (n + 5, "a a a a a a a a a a a a a"), (n + 6, "word " * 5000)]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in out} == brute_groups(rows)
    assert len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in out)


def test_repeated_rows_nulls_and_clashing_columns(spark):
    t = "one two three four five six seven"
    rows = [(1, t, "x", 1), (1, t, "y", 2), (None, t, None, 3), (3, t, "z", 4), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, kept int")
    out = sorted((r.doc_id or -1, r.group_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert out == [(-1, -1, True), (1, 1, True), (1, 1, True), (3, 1, False), (4, 4, True)]
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 4


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_the_weighted_similarity_without_bias():
    rng = np.random.default_rng(1)
    got = []
    for trial in range(60):
        h = mix(np.arange(60, dtype=np.uint64) + np.uint64(trial * 1000))
        a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = minhash.bag_signatures(np.concatenate([h, h]), np.repeat([0, 1], 60), np.concatenate([a, b]), 2, 128)
        got.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(got)) < 4 * np.std(got) / 60**0.5 and abs(np.mean(got)) < 0.02


def test_registers_do_not_depend_on_the_other_documents_of_a_block():
    texts = ["a b c d e f g h " * 9, "x y z", "q w e r t y u i o p " * 40]

    def sign(ts):
        raw = [t.encode() for t in ts]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        return minhash.bag_signatures(*multiset(*shingles(w, 5)), len(ts), 64)

    assert (sign(texts)[2] == sign(texts[2:])[0]).all()


def test_a_large_group_of_near_copies_that_are_not_all_alike(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(2000)]
    rows, n = [], 0
    for size, edits in ((240, 5), (60, 7), (90, 3)):
        base = [rng.choice(vocab) for _ in range(160)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds, meet in ((0, 16), (3, 1024)):
        monkeypatch.setattr(minhash, "ROUNDS", rounds)
        monkeypatch.setattr(minhash, "MEET", meet)
        assert {r.doc_id: r.group_id for r in minhash.near_duplicates(df).collect()} == want


def test_unequal_texts_of_one_doc_id_are_compared_as_themselves(spark):
    rng = random.Random(21)
    bases = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(0, 12, 2):  # two texts under one id, each with a near copy under another
        rows += [(i, bases[i]), (i, bases[i + 1]), (100 + i, bases[i] + " end"), (101 + i, bases[i + 1] + " end")]
    want = {x: i for i in range(0, 12, 2) for x in (i, 100 + i, 101 + i)}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(1)
        out = minhash.near_duplicates(df).collect()
        assert len(out) == len(rows) and {r.doc_id: r.group_id for r in out} == want


def test_members_of_open_keys_meet_their_texts_once_before_they_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEET", 8)
    plans = []

    class Seen(Workspace):
        def save(self, df, name):
            if name in ("blocks", "late-links"):
                plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().save(df, name)

    rng = random.Random(5)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = f"v{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ws=Seen(spark, "seen")).collect()
    assert {r.doc_id: r.group_id for r in out} == brute_groups(rows)
    blocks, late = plans
    assert "Join" not in blocks
    joins = [i for i, line in enumerate(late.split("\n")) if "Join Inner" in line and "version" in line]
    spread = [i for i, line in enumerate(late.split("\n")) if "Generate" in line]
    assert len(joins) == len(spread) == 1 and spread[0] < joins[0]  # the join comes below, so first
