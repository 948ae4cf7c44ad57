"""Runs against plain counting, and the query's digests against plain Python."""

import hashlib
import re
import zlib

import numpy as np
from foliate.llm import periodic, queries
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(words, least, times):
    """(start, length, period) of all maximal stretches, by their definition."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if e > s and length >= max(least, times * q):
                stretch = words[s : s + length]
                if all(any(stretch[i] != stretch[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((s, length, q))
            s = max(e, s + 1) if e > s else s + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def by_text(found, n_texts):
    return [[tuple(int(v) for v in r[1:]) for r in sorted(found[found[:, 0] == t].tolist(), key=lambda r: (r[1], r[3]))] for t in range(n_texts)]


def together(texts, least, times):
    counts = np.array([len(t) for t in texts], np.int64)
    number = np.array([w for t in texts for w in t], np.int64)
    return by_text(periodic.runs(number, counts, least, times), len(texts))


word = st.integers(0, 2)
periods = st.builds(lambda root, k, tail: (root * k) + root[:tail], st.lists(word, min_size=1, max_size=5), st.integers(1, 8), st.integers(0, 5))
text = st.lists(periods, max_size=6).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=400, deadline=None)
@given(st.lists(text, min_size=1, max_size=4), st.sampled_from([(1, 3), (6, 3), (9, 4), (24, 3)]))
def test_runs_are_all_and_only_those_of_the_definition(texts, bounds):
    assert together(texts, *bounds) == [brute(t, *bounds) for t in texts]


def test_fibonacci_and_one_word_texts():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    texts = [b, [7] * 300, list(range(100)), [], [5]]
    assert together(texts, 3, 3) == [brute(t, 3, 3) for t in texts]
    assert together(texts, 24, 3)[1] == [(0, 300, 1)]


def planted(doc_id, text):
    """The contract's words of a document."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    found = brute(words, 24, 3)
    best = (None,) * 4
    if found:
        s, n, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_on_a_fixture(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(None, "a b " * 30, "x"), (1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, "z " * 40, None), (4, "z " * 40, None), (5, "é ü " * 20 + "wörter \x85   " * 9, "x")]
    for i in range(6, 300):
        n = int(rng.integers(1, 120))
        rows.append((i, "  ".join(f"w{v}" for v in rng.integers(0, 4 if i % 2 else 400, n)) + "\n" * (i % 3), "x"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert sum(r.n_runs > 0 for r in got) > 15


def test_operator_on_an_empty_table_and_a_very_long_text(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic.periodic_runs(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000)) + " x y" * 60_000
    row = periodic.periodic_runs(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).first()
    assert row.n_words == 270_000
    assert [(r.start, r.length, r.period) for r in row.runs] == [(150_000, 120_000, 2)]
    assert row.collapsed == " ".join(f"w{i}" for i in range(150_000)) + " x y"
