"""Best-fit packing of tokenised documents, hierarchically.

A document's ids and an end id are cut into pieces of at most the sequence
length. Full pieces are sequences as they are. The rest is packed best-fit, in
decreasing size, within each partition; bins that are nearly full are emitted,
and the underfull ones become items of a smaller number of partitions for the
next round. Rounds end when all that is left fits one task of bounded size or
a round no longer lowers the number of underfull bins by LEAST_GAIN: what
remains then has no small items left to fill bins with.

Tokenising works on units, stretches of text that the tokenizer never joins:
maximal runs outside ASCII white space, cut between ASCII letters and the
punctuation marks of UNIT_MARKS. Each distinct unit is encoded once and kept,
with its bytes as the key, in a bounded per-worker cache; a text's ids are its
units' ids in order. A unit of letters alone is one word to the tokenizer, whose
model takes it as it is; normalising and splitting cost more than the merges.

Defined results: a null, empty or blank text is one piece of the end id alone;
repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import WHITE, blocks, distinct, spans
from .workspace import Workspace

LENGTH = 2048
END = 0
#: Bins with at most this much room left are emitted.
SLACK = 8
#: Share of the underfull bins that a round must do away with for another to follow.
LEAST_GAIN = 0.01
#: Items a task packs on average.
TASK_ITEMS = 60_000
#: Distinct units a worker keeps, and the ids of all of them.
CACHE, CACHE_IDS = 200_000, 2_000_000
#: Units the tokenizer gets at once; its results take many times the room of their ids.
PORTION = 8192
#: Marks that never join a letter in the tokenizer's own splitting: no apostrophe, and none of <|>,
#: which combine with a following accent or belong to special tokens.
UNIT_MARKS = b"!\"#$%&()*+,-./:;?@[]_{}~"
#: Letters of units that the model takes as they are lie below: Latin, Greek, Cyrillic and what is between them.
LETTERS = 0x530

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[list(UNIT_MARKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Token ids of whole texts, by distinct units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _letters(self.tokenizer)
        self.word = re.compile(f"[{''.join(map(chr, self.letters))}]+")
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        kind = _KIND[data]
        solid = ~WHITE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        if n:
            cut[1:n] |= (kind[:-1] + kind[1:] == 3) & (kind[:-1] != 0) & (kind[1:] != 0)
        first, last = np.ones(n, bool), np.ones(n, bool)
        if n:
            first[1:] = ~solid[:-1] | cut[1:n]
            last[:-1] = ~solid[1:] | cut[1:n]
        return np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's ids)."""
        if not _special(data):
            data = _LOWER[data]  # the tokenizer lower-cases; special tokens alone keep their case
        starts, ends = self.units(data, offsets)
        which, units = distinct(data, starts, ends)
        length, begin, source = self._lookup(spans(units))
        length, begin = length[which], begin[which]
        stop = np.cumsum(length)
        ids = source[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - length), length)]
        doc = np.searchsorted(offsets, starts, "right") - 1
        per_doc = np.bincount(doc, weights=length, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_doc)])

    def _lookup(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids, where they begin, the array they are in) of distinct units, encoding those not known by their bytes."""
        if len(self.place) + len(units) > CACHE:
            self._clear()
        place = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(place < 0)
        ends, flat = [self.ends], [self.ids]
        for lo in range(0, len(new), PORTION):
            found = self._found([units[i].decode("utf-8", "replace") for i in new[lo : lo + PORTION].tolist()])
            size = np.fromiter(map(len, found), np.int64, len(found))
            ends.append(ends[-1][-1] + np.cumsum(size))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))
        place[new] = len(self.ends) - 1 + np.arange(len(new))
        all_ends, all_ids = np.concatenate(ends), np.concatenate(flat)
        if len(all_ends) <= CACHE and len(all_ids) <= CACHE_IDS:
            self.ends, self.ids = all_ends, all_ids
            self.place.update((units[i], p) for i, p in zip(new.tolist(), place[new].tolist()))
        return all_ends[place + 1] - all_ends[place], all_ends[place], all_ids

    def _found(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit."""
        merge, letters, word = self.model.tokenize, self.letters, self.word.fullmatch
        found = [[t.id for t in merge(u.translate(letters))] if word(u) else None for u in units]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found


def _letters(tokenizer) -> dict[int, str]:
    """What the tokenizer gives its model for each letter, of those that are one word with the letters around them."""
    clean, split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
    found = ((c, split(clean(f"a{chr(c)}a"))) for c in range(LETTERS) if chr(c).isalpha())
    return {c: words[0][0][1:-1] for c, words in found if len(words) == 1}


def _special(data: np.ndarray) -> bool:
    """Whether a special token's string may be there in any case."""
    return len(data) > 1 and bool(((data[:-1] == 60) & (data[1:] == 124)).any())


_ENCODERS: dict[str, Encoder] = {}


def _cut(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int) -> Iterator[pa.RecordBatch]:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            ids, at = _ENCODERS[path].encode(data, offsets)
            n = np.diff(at) + 1
            ids = np.insert(ids.astype("<u4"), at[1:], end)
            at = np.concatenate([[0], np.cumsum(n)])
            pieces = (n + length - 1) // length
            row = np.repeat(np.arange(hi - lo), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * length
            size = np.minimum(length, n[row] - start)
            raw, b = ids.tobytes(), 4 * (at[row] + start)
            crc = [zlib.crc32(raw[x : x + y]) for x, y in zip(b.tolist(), (4 * size).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every row of docs."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _cut(it, tokenizer, length, end), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, its offset there, fill of each bin).

    Bins are kept by the room they have left, so an item takes the fullest bin it fits in at once.
    """
    order = np.argsort(-sizes, kind="stable").tolist()
    into, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit r is set if a bin has room r
    for i in order:
        n = int(sizes[i])
        fitting = some >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            b, r = len(fill), room
            fill.append(0)
        into[i], offset[i] = b, fill[b]
        fill[b] += n
        by_room[r - n].append(b)
        some |= 1 << (r - n)
    return into, offset, np.array(fill, np.int64)


def _pack(frames: Iterator[pd.DataFrame], room: int) -> Iterator[pd.DataFrame]:
    """Packs the items (item, size) of a partition; bins are named by their first item."""
    held = [f for f in frames if len(f)]
    if held:
        yield _packed(pd.concat(held), room)


def _packed(f: pd.DataFrame, room: int) -> pd.DataFrame:
    f = f.sort_values("item")  # the same result whatever order rows arrive in
    into, offset, fill = best_fit(f["size"].to_numpy(), room)
    item = f["item"].to_numpy()
    first = np.zeros(len(fill), np.int64)
    first[into[offset == 0]] = item[offset == 0]
    return pd.DataFrame({"item": item, "bin": first[into], "offset": offset, "fill": fill[into]})


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, slack: int = SLACK, ws: Workspace | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece, every piece in one place."""
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "packing")
    cut = ws.save(pieces(docs, tokenizer, length, end).withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = cut.where(F.col("length") < length).select("item", F.col("length").alias("size"))
    n = items.count()
    placed, rounds = None, 0
    while n:
        parts = max(1, -(-n // TASK_ITEMS))
        dealt = items.coalesce(1) if parts == 1 else items.repartition(parts, F.xxhash64("item", F.lit(rounds)))
        out = ws.save(dealt.mapInPandas(lambda it: _pack(it, length), "item long, bin long, offset long, fill long"), "round")
        here = out.select("item", "bin", F.col("offset").alias("o"))
        if placed is None:
            placed = here.select("item", "bin", F.col("o").alias("offset"))
        else:  # items of this round are bins of the last
            moved = here.select(F.col("item").alias("bin"), F.col("bin").alias("next"), "o")
            placed = ws.save(placed.join(moved, "bin", "left").select("item", F.coalesce("next", "bin").alias("bin"), (F.col("offset") + F.coalesce("o", F.lit(0))).alias("offset")), "placed")
        under = out.where((F.col("offset") == 0) & (F.col("fill") < length - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        left = under.count()
        if parts == 1 or left > (1 - LEAST_GAIN) * n:
            break
        items, n, rounds = under, left, rounds + 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if placed is None:
        return cut.select(*names, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.join(placed, "item", "left").select(
        *names, F.coalesce("bin", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset")
    )
