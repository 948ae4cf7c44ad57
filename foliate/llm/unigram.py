"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary match in a word; dynamic
programming over end positions carries the best score and the piece count of
its path, never the path. The vocabulary's pieces start words with a mark and
hold no white space, so a text's count is the sum of its words' counts, and
each distinct word is solved once and kept, with its bytes as the key, in a
per-worker cache of bounded size.

Rules of the exact tokenizer (the unigram model of the tokenizers library, with
byte fallback): scores add up from the word's start in double precision; of
paths with equal scores to one position the one whose last piece starts first
wins; where no one-character piece matches, a character may pass as unknown at
10 below the least score, and counts as many pieces as it has bytes.

Defined results: null, empty and wordless texts have 0 pieces and score 0;
repeated rows each get their result, as do rows with a null doc_id; a very long
text is a block of its own and is read whole; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, blocks
from .workspace import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words a worker keeps, and the longest (in bytes) of them.
CACHE, LONGEST = 200_000, 256


class Counter:
    """Pieces, unknown bytes and score of words under a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        seen: dict[str, float] = {}
        for piece, score in vocabulary:
            seen.setdefault(piece, score)
        for piece, score in seen.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in seen if len(p) == 1}
        self.unknown = min(seen.values()) - UNKNOWN_PENALTY
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """(pieces, of these bytes of unknown characters, score) of one word, mark included."""
        n = len(word)
        best, pieces, unknown = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        done = 0
        single, low = self.single, self.unknown

        def fill(upto: int) -> None:
            # ends that no match has closed yet, and unknown characters: later starts lose ties
            nonlocal done
            while done < upto:
                s, e = done, done + 1
                if word[s] not in single:
                    score = best[s] + low
                    if best[e] is None or score > best[e]:
                        size = len(word[s].encode())
                        best[e], pieces[e], unknown[e] = score, pieces[s] + size, unknown[s] + size
                done = e

        at, start = 0, 0
        for last, (length, score) in self.automaton.iter(word):
            e = last + 1
            if e != at:
                fill(at)
                fill(e - 1)
                at = e
            s = e - length
            if best[s] is None:
                continue
            score += best[s]
            old = best[e]
            if old is None or score > old or (score == old and s < start):
                best[e], pieces[e], unknown[e], start = score, pieces[s] + 1, unknown[s], s
        fill(n)
        return pieces[n], unknown[n], best[n]

    def words(self, words: Words) -> np.ndarray:
        """3 x words: pieces, unknown bytes, score."""
        number, found = words.numbers(), []
        for text in words.distinct():
            result = self.known.get(text)
            if result is None:
                result = self.word(marked(text.decode("utf-8", "replace")))
                if len(text) <= LONGEST:
                    if len(self.known) >= CACHE:
                        self._clear()
                    self.known[text] = result
            found.append(result)
        return np.array(found, np.float64).reshape(-1, 3).T[:, number]


def marked(word: str) -> str:
    """A word with the mark in front, unless it has one of its own there."""
    return word if word.startswith(MARK) else MARK + word


def load(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.IdToPiece(i), model.GetScore(i)) for i in range(model.GetPieceSize())]


_COUNTERS: dict[str, Counter] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load(path))
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            words = Words(data, offsets)
            sums = [np.bincount(words.doc, weights=x, minlength=hi - lo) for x in _COUNTERS[path].words(words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(words.counts, pa.int64()), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(sums[2])],
                ["doc_id", "n_words", "n_tokens", "n_unknown_bytes", "score"],
            )


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown_bytes, score, per row of docs. vocabulary: path of a sentencepiece model."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _count(it, vocabulary), "doc_id long, n_words long, n_tokens long, n_unknown_bytes long, score double"
    )
