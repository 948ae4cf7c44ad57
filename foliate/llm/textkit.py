"""Vectorised work on the words of whole texts, over Arrow buffers.

Words are the maximal runs of bytes outside space and \\x09-\\x0D, in UTF-8.
Equality inside a block of texts is exact: distinct() numbers equal spans of
bytes alike and no others. What must agree between blocks is a 64-bit hash of
each distinct word, and runs of words are hashed by a tree of mixing steps.
Such hashes only say where texts should meet; wherever equality decides a
result, numbers or bytes are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_LEFT = U(0xC2B2AE3D27D4EB4F)
_LONG = 512
#: Bytes of text worked on at once.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if offsets else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0), about size bytes each and one text at least."""
    data, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(number of each span, the distinct spans by number): equal bytes, and they alone, have equal numbers.

    The spans are not empty, do not overlap and come in order.
    """
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    flat = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def spans(column: pa.LargeBinaryArray) -> list[bytes]:
    data, offsets = buffers(column)
    whole, at = data.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def span_hashes(column: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each value, eight bytes a step; long ones by XXH3."""
    data, offsets = buffers(column)
    size = np.diff(offsets)
    out = mix(size.astype(np.uint64) + U(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # of the eight bytes from each place on
    on, step = np.flatnonzero(size <= _LONG), 0
    while len(on):
        left = size[on] - 8 * step
        on, left = on[left > 0], left[left > 0]
        tail = U(2**64 - 1) >> (U(64) - U(8) * np.minimum(left, 8).astype(np.uint64))
        out[on] = mix(out[on] * _LEFT + (eight[offsets[on] + 8 * step] & tail))
        step += 1
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]])
    return out


class Words:
    """The words of a block of texts: byte spans, the text each is of, numbers, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        solid = ~WHITE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            np.logical_or(~solid[:-1], edge[1:n], out=before[1:])
            np.logical_or(~solid[1:], edge[1:n], out=after[:-1])
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & after) + 1
        self.solid = solid
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self._numbers = self._distinct = self._hashes = None

    def numbers(self) -> np.ndarray:
        """Equal words of the block, and they alone, have equal numbers, from 0 on."""
        if self._numbers is None:
            self._numbers, self._distinct = distinct(self.data, self.starts, self.ends)
        return self._numbers

    def distinct(self) -> list[bytes]:
        """The distinct words, by number."""
        self.numbers()
        return spans(self._distinct)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every block."""
        if self._hashes is None:
            number = self.numbers()
            self._hashes = span_hashes(self._distinct)[number]
        return self._hashes

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each starts in that (and one would start after the last)."""
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts + 1, out=at[1:])
        out = np.full(at[-1], 32, np.uint8)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        out[inside] = self.data[self.solid]
        return out.tobytes(), at


def hashed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two neighbouring runs from theirs."""
    return mix(x * _LEFT + y)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers: equal pairs, and they alone, get equal ones."""
    pair = x * (int(y.max()) + 1 if len(y) else 1) + y
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


class Runs:
    """Hashes or exact numbers of runs of words, put together from runs of 1, 2, 4, 8 ... words."""

    def __init__(self, words: np.ndarray, join: Callable = hashed):
        self.n, self.join, self.powers = len(words), join, [words]

    def fixed(self, k: int) -> np.ndarray:
        """Of the k words from each position that has so many behind it."""
        size = max(0, self.n - k + 1)
        if not size:
            return self.powers[0][:0]
        out, have = None, 0
        for bit in reversed(range(k.bit_length())):
            if k >> bit & 1:
                part = self._power(bit)[have : have + size]
                out = part if out is None else self.join(out, part)
                have += 1 << bit
        return out

    def _power(self, bit: int) -> np.ndarray:
        while len(self.powers) <= bit:
            last, half = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(self.join(last[: len(last) - half], last[half:]))
        return self.powers[bit]


def shingles(words: Words, k: int, exactly: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, or numbers that are exact within the block, with the text each is of.

    A text of 1 to k-1 words has one shingle, of all its words; one without words has none.
    """
    runs = Runs(words.numbers(), exact) if exactly else Runs(words.hashes())
    h, d = [], []
    for size in range(1, k + 1):
        g = runs.fixed(size)
        if size < k:
            on = np.flatnonzero(words.counts == size)
            at, doc = words.first[on], on
        else:
            at = np.flatnonzero(words.doc[: len(g)] == words.doc[k - 1 :]) if len(g) else np.zeros(0, np.int64)
            doc = words.doc[at]
        h.append(g[at] * k + (k - size) if exactly else g[at] + U(size))
        d.append(doc)
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def multiset(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash or number, text) with their counts, in order of text."""
    if not len(h):
        return h, d, np.zeros(0, np.int64)
    order = np.lexsort([h, d])
    a, b = h[order], d[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(h)]]))
    return a[at], b[at], n


def repeated(number: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Marks entries whose (number, text) occurs twice or more."""
    if not len(number):
        return np.zeros(0, bool)
    order = np.lexsort([number, d])
    a, b = number[order], d[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(number), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_runs(words: Words, k: int) -> np.ndarray:
    """Positions at which a run of k words starts that is found twice or more in its text.

    Hashes pick the runs that may be; of these, the words are compared.
    """
    g = Runs(words.hashes()).fixed(k)
    if not len(g):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[: len(g)] == words.doc[k - 1 :])
    at = at[repeated(g[at], words.doc[at])]
    number = words.numbers()[at]
    for j in range(1, k):
        number = exact(number, words.numbers()[at + j])
    return at[repeated(number, words.doc[at])]
