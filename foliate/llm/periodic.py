"""Periodic runs of words: stretches that repeat one phrase three times or more.

By the runs theorem, every run of period q holds a Lyndon word of q words that
is, under the words' order or its inverse, the longest Lyndon word at its
place. Longest Lyndon words end before the next smaller (for the inverse order,
next larger) value of the inverse suffix array, with the end of a text as the
least word. Each is extended to the right by the longest common prefix of the
suffixes at its start and behind it, a range minimum over neighbours' common
prefixes, and to the left by the same over the reversed text.

All of it is arrays over a block of texts: suffixes are sorted by prefix
doubling, where only those still tied take part, and equal words have equal
numbers, so no hash decides anything.

Defined results: a null, empty or blank text has no words and no runs; repeated
rows are judged each; an empty table gives no rows; columns but the id and the
text are left out. A text is held whole by one task, with some 250 bytes a word
(up to 2^20 words; eight more for each doubling).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import Words, blocks
from .workspace import small_batches

#: A run has this many words, and its period this many times.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Range minima of so many words are asked for at once.
PORTION = 1 << 18


class Suffixes:
    """Suffix array of texts laid out one after another, each with an end mark behind it; suffixes end with their text.

    words: number of each place's word, from 1 on, or 0 at an end mark. text: the text of each place, in order.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.n = len(words)
        self._levels: list[np.ndarray] = []
        key = text * (int(words.max()) + 1 if self.n else 1) + words
        self.array = np.argsort(key, kind="stable").astype(np.int32)
        rank = np.empty(self.n, np.int32)
        slots, length = np.arange(self.n, dtype=np.int32), 1
        place, key = self.array, key[self.array]
        while True:
            # slots: of those still tied, in order; place: what is there now; key: equal for ties
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            first = slots[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))] if len(key) else slots
            rank[place] = first
            self._levels.append(rank.copy())
            alone = head.copy()
            alone[:-1] &= head[1:]
            slots, place, first = slots[~alone], place[~alone], first[~alone]
            if not len(slots):
                break
            # a tied suffix has more words than those compared, so the place behind them is of its text
            key = first.astype(np.int64) * self.n + rank[place + length]
            order = np.argsort(key, kind="stable")
            place, key = place[order], key[order]
            self.array[slots] = place
            length *= 2
        self.rank = rank
        self._common: list[np.ndarray] | None = None

    def _neighbours(self) -> np.ndarray:
        """Words that the suffix at each rank shares with the one before it."""
        a, b = self.array[:-1], self.array[1:]
        out = np.zeros(self.n, np.int32)
        on = np.flatnonzero(self._levels[0][a] == self._levels[0][b])
        a, b, have = a[on].copy(), b[on].copy(), np.zeros(len(on), np.int32)
        for k in reversed(range(len(self._levels))):
            step = np.where(self._levels[k][a] == self._levels[k][b], np.int32(1 << k), np.int32(0))
            have += step
            a += step
            b += step
        out[on + 1] = have
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at places i and j of one text share; i and j differ."""
        if not len(i):
            return np.zeros(0, np.int32)
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        if self._common is None:
            self._common = [self._neighbours()]
            self._levels = []
        table = self._common
        while len(table) <= level.max():  # minima of 2, 4, 8 ... ranks
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        out = np.empty(len(i), np.int32)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(table[k][low[on]], table[k][high[on] - (1 << k)])
        return out


def _next(rank: np.ndarray, widest: int, smaller: bool) -> np.ndarray:
    """The next place with a smaller (or larger) rank, at most some widest places on; len(rank) if there is none."""
    value = rank if smaller else -rank
    table = [value]
    while 1 << len(table) <= widest:
        half = 1 << (len(table) - 1)
        if len(table[-1]) <= half:
            break
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    out = np.arange(1, len(rank) + 1)
    for k in reversed(range(len(table))):
        inside = np.flatnonzero(out + (1 << k) <= len(rank))
        skip = inside[table[k][out[inside]] > value[inside]]
        out[skip] += 1 << k
    return out


def _layout(number: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with end marks, text of each place, first place of each text and one behind the last)."""
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts + 1, out=first[1:])
    text = np.repeat(np.arange(len(counts)), counts + 1)
    words = np.zeros(first[-1], np.int64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    words[inside] = number + 1
    return words, text, first


def runs(number: np.ndarray, counts: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (text, start, length, period), in that order, of all runs of at least least words and times (2 or more) periods.

    number: words of all texts one after another, equal numbers for equal words; counts: words of each text.
    """
    none = np.zeros((0, 4), np.int64)
    fits = counts >= max(least, times)
    if not fits.all():  # short texts have none
        found = runs(number[np.repeat(fits, counts)], counts[fits], least, times) if fits.any() else none
        found[:, 0] = np.flatnonzero(fits)[found[:, 0]]
        return found
    words, text, first = _layout(number, counts)
    forward = Suffixes(words, text)
    widest = int(counts.max(initial=0))
    roots = []
    for smaller in (True, False):
        end = _next(forward.rank, widest, smaller)
        i = np.flatnonzero(end < first[text + 1] - 1)
        i = i[words[i] == words[end[i]]]
        roots.append(np.stack([i, end[i]]))
    i, j = np.concatenate(roots, axis=1)
    p = j - i
    # of a run with three periods, some root is followed by itself
    right = np.concatenate([forward.common(i[a : a + PORTION], j[a : a + PORTION]) for a in range(0, max(1, len(i)), PORTION)])
    whole = right >= (times - 2) * p
    i, j, p, right = i[whole], j[whole], p[whole], right[whole]
    if not len(i):
        return none
    # the texts that have roots, reversed: place t of a text of n words is at n - 1 - t
    del forward
    own, k = np.unique(text[i], return_inverse=True)
    kept = np.isin(text, own)
    n = counts[own]
    mirror, back_text, back_first = _layout(words[kept & (words > 0)] - 1, n)
    place = np.arange(len(mirror)) - back_first[back_text]
    turned = back_first[back_text] + n[back_text] - 1 - place
    mirror = np.where(mirror > 0, mirror[np.maximum(turned, 0)], 0)
    backward = Suffixes(mirror, back_text)
    at, then = i - first[text[i]], j - first[text[j]]
    left = np.zeros(len(i), np.int64)
    on = np.flatnonzero(at > 0)
    end = back_first[k[on]] + n[k[on]]
    left[on] = backward.common(end - at[on], end - then[on])
    found = np.stack([text[i], at - left, left + p + right, p], axis=1)
    found = found[found[:, 2] >= np.maximum(least, times * p)]
    return np.unique(found, axis=0)


def _collapsed(words: Words, found: np.ndarray) -> pa.Array:
    """Each text without what its runs hold behind their first period; words joined by one space."""
    edge = np.zeros(len(words.starts) + 1, np.int64)
    start = words.first[found[:, 0]] + found[:, 1]
    np.add.at(edge, start + found[:, 3], 1)
    np.add.at(edge, start + found[:, 2], -1)
    keep = np.cumsum(edge[:-1]) == 0
    spaced, at = words.spaced()
    mask = np.repeat(keep, np.diff(at))
    held = np.concatenate([[0], np.cumsum(keep)])[words.first]
    last = np.flatnonzero(keep)[held[1:][held[1:] > held[:-1]] - 1]  # the last kept word of each text has no space
    mask[at[last + 1] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(mask)])[at[words.first]].astype(np.int64)
    data = np.frombuffer(spaced, np.uint8)[mask]
    return pa.Array.from_buffers(pa.large_string(), words.n_docs, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _found(column: pa.Array, least: int, times: int) -> Iterator[tuple[int, int, np.ndarray, pa.Array, pa.Array]]:
    """(first row, row after the last, words of each, runs of each, collapsed texts) of blocks of texts."""
    for lo, hi, data, offsets in blocks(column):
        words = Words(data, offsets)
        found = runs(words.numbers(), words.counts, least, times)
        ends = np.searchsorted(found[:, 0], np.arange(words.n_docs + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], fields=list(_RUN)))
        yield lo, hi, words.counts, lists, _collapsed(words, found)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """id, n_words, runs (start, length and period in words, from word 0, in order of start and period), collapsed.

    collapsed is the text without what runs hold behind their first period, words joined by one space.
    """
    if times < LEAST_TIMES:
        raise ValueError(f"times must be {LEAST_TIMES} or more")
    small_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, n, lists, texts in _found(batch.column(1), least, times):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n, pa.int64()), lists, texts.cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(judge, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
