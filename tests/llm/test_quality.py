import math
import re
from collections import Counter

import pytest
from foliate.llm import quality
from foliate.llm.textkit import Words, buffers

import numpy as np
import pyarrow as pa

TEXTS = [
    None,
    "",
    " \n\t",
    "one line\none line\n one line\n\n\none line",
    "a b c d e f g h i " * 4 + "tail",
    "x#*$%&|<> é à über 東京 nbsp stays\x0bsplit\x1cnot",
    "the cat sat on the mat and looked at the dog for a very long time until it was dark outside again",
    "go " * 50,
    "\n\n",
    "é\né\né",
]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain(t):
    w = words(t)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))


def test_base_counts_equal_a_plain_count(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = {r.doc_id: r for r in quality.quality_rules(df, df.where("doc_id = 6")).collect()}
    for i, t in enumerate(TEXTS):
        r, want = out[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_scores_equal_a_plain_log_likelihood_ratio(spark):
    texts = [t for t in TEXTS if words(t)] + ["shared words of a trusted text"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = [6 - 3, len(texts) - 1]
    got = {r.doc_id: r.score for r in quality.quality_rules(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets=512).collect()}

    def grams(t):
        w = Words(*buffers(pa.array([t])))
        return quality.ngrams(w, 512)[0].tolist()

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        target.update(grams(t) if i in trusted else [])
    nr, nt = sum(raw.values()) + 512, sum(target.values()) + 512
    for i, t in enumerate(texts):
        g = grams(t)
        assert len(g) == 2 * len(words(t)) - 1
        want = sum(math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr) for b in g) / len(g)
        assert got[i] == pytest.approx(want, abs=1e-8)


def test_nothing_trusted_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, TEXTS[6], "a"), (1, TEXTS[6], "b"), (None, "x " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = quality.quality_rules(df, df.where("false")).collect()
    assert len(out) == 3 and {r.score for r in out} == {0.0} and out[0] == out[1] and out[0].kept
    assert quality.quality_rules(df.where("false"), df).count() == 0


def test_every_trusted_row_counts(spark):
    docs = spark.range(20_400).selectExpr("id as doc_id", "concat('w', id % 50, ' of ', id) as text")
    ratios = quality.log_ratios(docs, docs.select("doc_id"), buckets=512)
    assert not ratios.any()  # all are trusted: target and raw are one


def test_rows_without_doc_id_count_as_raw_only(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "c d")], "doc_id long, text string")
    same = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    one = df.where("doc_id = 1")
    got = quality.log_ratios(df, df, buckets=512)
    assert got.any() and (got == quality.log_ratios(same, one, buckets=512)).all()


def test_a_text_longer_than_a_block():
    t = "word " * 10 + "\n" + "y" * (5 << 20)
    w = Words(*buffers(pa.array([t, "z"])))
    c = quality.base_counts(w)
    assert c["n_words"].tolist() == [11, 1] and c["word_chars"].tolist() == [40 + (5 << 20), 1]
    assert isinstance(c["n_dup_lines"], np.ndarray)
