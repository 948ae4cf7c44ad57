import random
import re
from collections import defaultdict

import pytest
from foliate.llm import suffixes


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, k):
    """doc_id -> repeated word positions to remove: windows of k words that occur before."""
    first, out = {}, defaultdict(set)
    for i, t in sorted({(i, t) for i, t in rows if i is not None}):
        w = words(t)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in first and first[key] != (i, s):
                out[i] |= set(range(s, s + k))
            first.setdefault(key, (i, s))
    return out


def brute_firsts(rows, k):
    """doc_id -> word positions of windows that occur again later."""
    places, out = defaultdict(list), defaultdict(set)
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}):
        w = words(t)
        for s in range(len(w) - k + 1):
            places[tuple(w[s : s + k])].append((i, s))
    for p in places.values():
        if len(p) > 1:
            i, s = min(p)
            out[i] |= set(range(s, s + k))
    return out


def fixture():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    common, long, rows = some(24), some(400), []
    for i in range(60):
        w = some(rng.randrange(0, 80))
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = common
        if i % 4 == 0:
            a = rng.randrange(0, 350)
            w += long[a : a + rng.randrange(10, 50)]
        if i % 7 == 0:
            w = common[4:] + w + common[:20]
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(60, rows[0][1]), (61, rows[4][1] + " tail"), (62, "head " + rows[4][1]), (63, "a " * 100), (64, "a b " * 40), (65, None), (66, ""), (67, "é ü " * 30), (0, rows[0][1]), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("length,gram,most", [(20, 5, 500), (20, 5, 3), (20, 20, 500), (8, 2, 500), (8, 2, 1)])
def test_equals_brute_force(spark, length, gram, most):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    want = brute(rows, length)
    got = {True: defaultdict(set), False: defaultdict(set)}
    for r in suffixes.report(df, length, gram, most).collect():
        got[r.kept][r.doc_id] |= set(range(r.word_start, r.word_end))
        assert r.word_end - r.word_start >= length
    assert got[False] == {i: p for i, p in want.items() if p}
    assert got[True] == brute_firsts(rows, length)
    cut = suffixes.cut_repeats(df, length, gram, most)
    assert cut.columns == df.columns
    texts = dict(rows)
    for r in cut.collect():
        keep = [w for p, w in enumerate(words(texts[r.doc_id])) if r.doc_id is None or p not in want[r.doc_id]]
        assert words(r.text) == keep and (r.text is None) == (texts[r.doc_id] is None)
        if r.doc_id is None or not want[r.doc_id]:
            assert r.text == texts[r.doc_id]


def test_byte_spans_cover_the_words(spark):
    t = "ä " * 3 + "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, t), (2, "zz\n" + t)], "doc_id long, text string")
    first, r = suffixes.report(df, 10, 4).orderBy("doc_id").collect()
    assert (first.doc_id, first.kept, first.byte_start, first.byte_end) == (1, True, 0, len(t.encode())) and (r.doc_id, r.kept) == (2, False)
    assert ("zz\n" + t).encode()[r.byte_start : r.byte_end].decode() == t


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.report(df).count() == 0 and suffixes.cut_repeats(df).count() == 0


def test_unequal_texts_of_one_doc_id_are_documents_of_their_own(spark):
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    part, other = some(30), some(30)
    texts = [(1, part + some(9)), (2, some(200) + part + some(5)), (2, some(40)), (2, some(15)), (3, some(3) + other), (3, some(60) + other + some(7)), (4, some(5))]
    rows = [(i, " ".join(w)) for i, w in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    want = []
    seen = set()
    # of the two texts of 3, the one of the lesser version keeps the passage
    both = {r.text: r.v for r in df.selectExpr("text", "xxhash64(text) as v").collect()}
    for i, t in sorted(rows, key=lambda r: (r[0], both[r[1]])):
        w, gone = t.split(), set()
        for s in range(len(w) - 19):
            if tuple(w[s : s + 20]) in seen:
                gone |= set(range(s, s + 20))
            seen.add(tuple(w[s : s + 20]))
        want.append((i, [x for j, x in enumerate(w) if j not in gone]))
    got = [(r.doc_id, r.text.split()) for r in suffixes.cut_repeats(df, 20, 5).collect()]
    assert sorted(got) == sorted(want)
    listed = sorted((r.doc_id, r.word_end - r.word_start, r.kept) for r in suffixes.report(df, 20, 5).collect())
    assert listed == [(1, 30, True), (2, 30, False), (3, 30, False), (3, 30, True)]


def test_equal_rows_of_one_doc_id_do_not_repeat_each_other(spark):
    rng = random.Random(8)
    t, u = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    df = spark.createDataFrame([(1, t), (1, t), (2, u), (2, u), (3, "x " + u)], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept, r.word_start, r.word_end) for r in suffixes.report(df).collect()) == [(2, True, 0, 60), (2, True, 0, 60), (3, False, 1, 61)]
    assert sorted((r.doc_id, r.text) for r in suffixes.cut_repeats(df).collect()) == [(1, t), (1, t), (2, u), (2, u), (3, "x ")]


def test_words_decide_and_not_their_hashes(spark):
    """Runs of two words in the Thue-Morse order and in its complement, which polynomial hashes take for one another."""
    bits = [bin(i).count("1") & 1 for i in range(1 << 11)]
    a, b = (" ".join(x[v] for v in bits[:512]) for x in (("ab", "ba"), ("ba", "ab")))
    rows = [(1, f"p {a}"), (2, f"q {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {True: defaultdict(set), False: defaultdict(set)}
    for r in suffixes.report(df).collect():
        got[r.kept][r.doc_id] |= set(range(r.word_start, r.word_end))
    assert got[False] == {i: p for i, p in brute(rows, 50).items() if p}


def test_a_line_that_many_documents_share_among_unlike_words(spark):
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = some(30)
    rows = [(i, " ".join(some(30) + line + some(30))) for i in range(700)]
    rows += [(700 + i, " ".join(["head"] * i + rows[i][1].split()[10:80] + some(20))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {True: defaultdict(set), False: defaultdict(set)}
    for r in suffixes.report(df).collect():
        got[r.kept][r.doc_id] |= set(range(r.word_start, r.word_end))
    assert got[False] == {i: p for i, p in brute(rows, 50).items() if p} and got[True] == brute_firsts(rows, 50)
