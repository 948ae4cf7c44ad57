"""Words and runs of words that polynomial hashes modulo 2**64 take for one another, in the operators that rest on equality."""

import re
from collections import Counter

import numpy as np
import pytest
from foliate.llm import minhash, packing, quality, queries, textkit, unigram


def morse(n, a, b):
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


WORDS = ["".join(morse(1024, "a", "b")), "".join(morse(1024, "b", "a"))]
RUNS = [" ".join(morse(512, "ab", "ba")), " ".join(morse(512, "ba", "ab"))]


def words(*texts):
    raw = [t.encode() for t in texts]
    return textkit.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))


def test_numbers_and_hashes_tell_words_apart():
    w = words(*WORDS, WORDS[0], "", "x" * 600, "x" * 601)
    assert w.numbers().tolist() == [0, 1, 0, 2, 3]
    assert len(set(w.hashes().tolist())) == 4 and w.distinct()[1].decode() == WORDS[1]
    again = words("y", "x" * 601, WORDS[1]).hashes()
    assert again[1:].tolist() == [w.hashes()[4], w.hashes()[1]]


def test_runs_are_told_apart():
    a, b = words(RUNS[0]), words(RUNS[1])
    assert textkit.Runs(a.hashes()).fixed(512)[0] != textkit.Runs(b.hashes()).fixed(512)[0]
    w = words(" ".join(RUNS))
    for k in (1, 3, 5, 12):
        t = " ".join(RUNS).split()
        runs = [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]
        number = textkit.Runs(w.numbers(), textkit.exact).fixed(k).tolist()
        assert len(set(number)) == len(set(runs)) == len(set(zip(number, runs)))


@pytest.mark.parametrize("text", ["a b c", "a b a b a b a b a b a b a b", "", "x " * 40, " ".join(RUNS), "one two three four five " * 3])
def test_shingles_and_repeats_equal_plain_code(text):
    w, t = words(text, "pad", text), text.split()
    want = Counter(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) if t else Counter()
    for exactly in (True, False):
        _, d, n = textkit.multiset(*textkit.shingles(w, 5, exactly))
        assert sorted(n[d == 0].tolist()) == sorted(want.values()) == sorted(n[d == 2].tolist())
    runs = Counter(tuple(t[i : i + 8]) for i in range(len(t) - 7))
    at = textkit.repeated_runs(w, 8)
    assert at[at < len(t)].tolist() == [i for i in range(len(t) - 7) if runs[tuple(t[i : i + 8])] > 1]


def test_op1_compares_words():
    assert minhash.overlap(WORDS[0], WORDS[1]) == 0 and minhash.overlap(RUNS[0], RUNS[0]) == 1
    shingles = [Counter(tuple(r.split()[i : i + 5]) for i in range(508)) for r in RUNS]
    assert minhash.overlap(*RUNS) == pytest.approx((shingles[0] & shingles[1]).total() / (shingles[0] | shingles[1]).total())


def test_op2_scores_each_word_as_itself():
    counter = unigram.Counter([("▁", -1.0), ("a", -2.0), ("b", -3.0), ("▁a", -1.5), ("▁b", -9.0)])
    found = counter.words(words(*WORDS))
    assert found[2].tolist() == [counter.word("▁" + x)[2] for x in WORDS] and found[2, 0] != found[2, 1]


def test_op3_compares_lines_and_windows():
    w = words("\n".join([*WORDS, WORDS[0]]), " ".join(RUNS))
    assert quality.duplicate_lines(w).tolist() == [1, 0]
    t = " ".join(RUNS).split()
    runs = Counter(tuple(t[i : i + 8]) for i in range(len(t) - 7))
    covered = {i + j for i in range(len(t) - 7) if runs[tuple(t[i : i + 8])] > 1 for j in range(8)}
    assert quality.repeated_words(w).tolist() == [0, len(covered)]


def test_op8_encodes_each_unit_as_itself():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    ids, at = packing.Encoder(path).encode(*(w := words(*WORDS), w.data, w.offsets)[1:])
    plain = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(x, add_special_tokens=False).ids for x in WORDS]


def test_white_space_is_the_contracts():
    text = "a b\x0bc\x0cd\x1ce f\tg"
    assert [x.decode() for x in words(text).distinct()] == re.findall(r"[^\x20\x09-\x0D]+", text)
