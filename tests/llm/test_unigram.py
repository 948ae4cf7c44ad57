import random
import re

import public_tokenizers
import pytest
from foliate.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact(vocabulary):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace("▁", "always", False)]
    )
    return t


def test_equals_the_exact_tokenizer_on_hard_and_random_texts(spark):
    vocabulary = unigram.load(PATH)
    t = exact(vocabulary)
    rng = random.Random(6)
    letters = "abcdeghinorstu" * 3 + "ABéßü東\U0001f600ñ.,!?*#<>0x1▁́\x1c "
    texts = ["the thntblere of then", "<0x0A> <unk> <s>", "日本語 текст नम \U0001f468‍\U0001f469", "HASHWH!! a***", "\x00 \x85", "w" * 3000, "▁▁ a▁b"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    rows = list(enumerate(texts)) + [(-1, None), (-2, ""), (-3, " \n"), (0, texts[0]), (None, "one two")]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, score string")
    got = unigram.token_counts(df, PATH).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, x in rows:
        assert by_id[i].n_tokens == len(t.encode(x or "", add_special_tokens=False).ids), x
        assert by_id[i].n_words == len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    assert unigram.token_counts(df.where("false"), PATH).count() == 0


def brute(word, vocabulary, low):
    """Best (score, tie order) over all segmentations, by recursion from the end."""
    from functools import lru_cache

    scores = dict(vocabulary)

    @lru_cache(None)
    def at(e):
        if e == 0:
            return 0.0, 0
        best = None
        for s in range(e):  # the first start wins ties
            if (s == 0 or at(s)) and at(s) is not None:
                piece = word[s:e]
                options = [(at(s)[0] + scores[piece], at(s)[1] + 1)] if piece in scores else []
                if e == s + 1 and piece not in scores:
                    options.append((at(s)[0] + low, at(s)[1] + len(piece.encode())))
                for o in options:
                    if best is None or o[0] > best[0]:
                        best = o
        return best

    return at(len(word))


def test_ties_equal_brute_force():
    vocabulary = [("a", -2.0), ("b", -1.0), ("ab", -3.0), ("ba", -3.0), ("aba", -5.0), ("bb", -2.0), ("▁", 0.0), ("▁a", -2.0), ("é", -1.5)]
    c = unigram.Counter(vocabulary)
    rng = random.Random(1)
    for _ in range(500):
        w = "▁" + "".join(rng.choice("ababéx") for _ in range(rng.randrange(1, 12)))
        pieces, _, score = c.word(w)
        assert (score, pieces) == pytest.approx(brute(w, vocabulary, -15.0)), w


def test_a_full_cache_changes_nothing(monkeypatch):
    import numpy as np
    from foliate.llm.textkit import Words

    data = np.frombuffer(" ".join(f"word{i % 97} {i}" for i in range(3000)).encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    c = unigram.Counter(unigram.load(PATH))
    want = c.words(w)
    monkeypatch.setattr(unigram, "CACHE", 10)
    assert (c.words(Words(data[:9000], np.array([0, 9000]))) == want[:, : len(Words(data[:9000], np.array([0, 9000])).starts)])[:, :-1].all()
    assert (c.words(w) == want).all()
