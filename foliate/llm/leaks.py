"""Benchmark decontamination: where windows of test items' words occur in documents.

Words are lower-cased in A-Z and numbered by the vocabulary of the items, which
is exact; a document's other words have no number. Windows of one length are
searched together by Wu-Manber's method, with words as letters: a table tells
for the two words at the end of the place looked at how far the search may
shift, as no window has them nearer to its end; where it says 0, the bucket of
windows that end with these two words is looked up, a fingerprint of all words
picks from it, and the words themselves are compared. Many stretches of a block
of documents are searched at once, as arrays.

Items are dealt to shards of bounded size by a hash of id and text, and each
shard takes one pass over the documents; with more than one, what the passes
find is joined by a row number. No text is longer than its task may hold.

Defined results: a null text has no words, as a document and as an item; a null
item_id counts as the empty string; an item_id with several texts is one item;
repeated documents are judged each; without items nothing is hit; columns but
the id and the text are left out. A document whose words are all the same, or
that is one window after another, is looked at word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import Words, blocks, mix
from .workspace import Workspace, small_batches

WINDOW = 10
#: Bytes of item texts in a shard, which the driver and each worker hold with their tables.
SHARD = 4 << 20
#: Words of a document that one stretch of the search has.
STRETCH = 256
#: Sets of windows whose items a worker remembers in a shard.
REMEMBERED = 1 << 12
U = np.uint64

#: Bytes as they are read: A-Z in lower case, digits and bytes of other letters as they are, the rest as spaces.
_READ = np.full(256, 32, np.uint8)
_READ[48:58] = np.arange(48, 58)
_READ[97:123] = _READ[65:91] = np.arange(97, 123)
_READ[128:] = np.arange(128, 256)


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_READ[data], offsets)


def _mixed(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A fingerprint of the length words from each start."""
    out = np.full(len(starts), length, np.uint64)
    for j in range(length):
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + words[starts + j].astype(np.uint64))
    return out


class Table:
    """Distinct windows of one length: shifts, buckets, words."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, length: int):
        self.length, self.block = length, min(2, length)
        rows = words[starts[:, None] + np.arange(length)].astype(np.int32)
        self.rows, self.of = np.unique(rows, axis=0, return_inverse=True)  # of: the distinct window of each start
        self.of = self.of.reshape(-1)
        size = 1 << max(10, int(4 * self.rows.size).bit_length())
        self.mask = U(min(size, 1 << 24) - 1)
        self.shift = np.full(int(self.mask) + 1, length - self.block + 1, np.int8)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self._slot(self._ends(self.rows, end)), np.int8(length - end))
        ends = self._ends(self.rows, length)
        prints = _mixed(self.rows.reshape(-1).astype(np.int64), np.arange(len(self.rows)) * length, length)
        order = np.lexsort([prints, ends])
        self.rows, ends, self.prints = self.rows[order], ends[order], prints[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.of = back[self.of]
        self.ends, self.first = np.unique(ends, return_index=True)
        self.last = np.append(self.first[1:], len(ends))

    def _ends(self, rows: np.ndarray, end: int) -> np.ndarray:
        """The block of words before column end, as one number."""
        last = rows[:, end - 1].astype(np.int64)
        return last if self.block == 1 else (rows[:, end - 2].astype(np.int64) << 32) | last

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (mix(block.astype(np.uint64)) & self.mask).astype(np.int64)

    def _before(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block that ends at each place."""
        last = words[at]
        return last if self.block == 1 else (words[at - 1] << 32) | (last & 0xFFFFFFFF)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of the distinct window) of all occurrences. words: int64, below 0 for those without a number."""
        m = self.length
        at = np.arange(m - 1, len(words), STRETCH)
        stop = np.minimum(at + STRETCH, len(words))
        found = []
        while len(at):
            step = self.shift[self._slot(self._before(words, at))].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        # the bucket of the last words
        block = self._before(words, at)
        k = np.minimum(np.searchsorted(self.ends, block), len(self.ends) - 1)
        on = self.ends[k] == block
        at, k = at[on], k[on]
        start = at - (m - 1)
        own = _mixed(words, start, m)
        low, high = self.first[k], self.last[k]
        end = high
        while (open_ := low < high).any():  # by halves, in all buckets at once: the first print that is not below
            mid = (low + high) // 2
            below = open_ & (self.prints[np.minimum(mid, len(self.prints) - 1)] < own)
            low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
        starts, windows = [], []
        while len(start):  # equal prints stand together; each is compared
            same = low < end
            same[same] = self.prints[low[same]] == own[same]
            start, low, end, own = start[same], low[same], end[same], own[same]
            equal = np.ones(len(start), bool)
            for j in range(m):
                equal &= words[start + j] == self.rows[low, j]
            starts.append(start[equal])
            windows.append(low[equal])
            low = low + 1
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (at[:0], at[:0])


class Items:
    """The windows of a shard's items, by length, and which items have each."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        self.ids = sorted(set(ids))
        rank = {x: i for i, x in enumerate(self.ids)}
        item = np.array([rank[x] for x in ids], np.int64)
        numbers, known, count, base = [], {}, [], 0
        for _, _, data, offsets in blocks(texts):
            words = read_words(data, offsets)
            own = np.array([known.setdefault(w, len(known)) for w in words.distinct()], np.int64)
            numbers.append(own[words.numbers()] if len(own) else np.zeros(0, np.int64))
            count.append(words.counts)
        self.vocabulary = pa.array(list(known), pa.large_binary())
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        counts = np.concatenate(count) if count else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        of = np.repeat(np.arange(len(counts)), counts)
        self.tables: list[Table] = []
        #: For each table: items by distinct window, and where each window's begin.
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        for length in range(1, window + 1):
            if length < window:
                own = np.flatnonzero(counts == length)
                starts, whose = first[own], own
            else:
                starts = np.arange(max(0, len(number) - window + 1))
                starts = starts[of[starts] == of[starts + window - 1]]
                whose = of[starts]
            if len(starts):
                table = Table(number, starts, length)
                pair = np.unique(np.stack([table.of, item[whose]], axis=1), axis=0)
                self.items.append((pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(table.rows) + 1))))
                del table.of
                self.tables.append(table)
        self._sets: dict[bytes, np.ndarray] = {}

    def _ranks(self, t: int, windows: np.ndarray) -> np.ndarray:
        """Items of a set of windows."""
        key = bytes([t]) + windows.tobytes()
        got = self._sets.get(key)
        if got is None:
            ranks, first = self.items[t]
            got = np.unique(np.concatenate([ranks[first[w] : first[w + 1]] for w in windows]))
            if len(self._sets) >= REMEMBERED:
                self._sets.clear()
            self._sets[key] = got
        return got

    def find(self, words: Words) -> tuple[np.ndarray, dict[int, list[str]]]:
        """(whether each word is hit, items of each text that has some, in order)."""
        hit, found = np.zeros(len(words.starts) + 1, np.int64), {}
        if not self.tables or not len(words.starts):
            return hit[:-1] > 0, {}
        words.numbers()
        number = pc.index_in(words._distinct, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[words.numbers()]
        for t, table in enumerate(self.tables):
            start, window = table.search(number)
            own = words.doc[start] == words.doc[start + table.length - 1]
            start, window = start[own], window[own]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + table.length, -1)
            pair = np.unique(np.stack([words.doc[start], window], axis=1), axis=0)
            for part in np.split(pair, np.flatnonzero(np.diff(pair[:, 0])) + 1) if len(pair) else ():
                ranks = self._ranks(t, part[:, 1])
                doc = int(part[0, 0])
                found[doc] = np.union1d(found[doc], ranks) if doc in found else ranks
        return np.cumsum(hit[:-1]) > 0, {d: [self.ids[r] for r in ranks] for d, ranks in found.items()}


def _spans(hit: np.ndarray, words: Words) -> pa.ListArray:
    """Maximal stretches (start, end) of hit words of each text."""
    n = len(hit)
    edge = np.zeros(n + 1, bool)
    edge[words.first] = True
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | edge[1:n]
    ends[:-1] &= ~hit[1:] | edge[1:n]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = words.doc[a]
    offsets = np.searchsorted(doc, np.arange(words.n_docs + 1))
    base = words.first[doc]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], fields=list(_SPAN)))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _searched(docs: DataFrame, keys: list[str], text_col: str, items: Items | None) -> DataFrame:
    """keys, n_words, spans, items: one pass over the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(len(keys))):
                words = read_words(data, offsets)
                hit, found = table.find(words) if table is not None else (np.zeros(len(words.starts), bool), {})
                names = pa.array([found.get(d, []) for d in range(words.n_docs)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), pa.array(words.counts, pa.int64()), _spans(hit, words), names], names=[*keys, "n_words", "spans", "items"])

    rows = docs.select(*keys, text_col)
    return rows.mapInArrow(search, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + f", {_FOUND}")


def _merged(spans: Column) -> Column:
    """Sorted stretches, those that meet or overlap as one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def shards(benchmark: DataFrame, shard: int = SHARD, item_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """id and text of the distinct items, in parts of about shard bytes, dealt by a hash of id and text."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = -(-size // shard)
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)]


def _items(part: DataFrame, window: int) -> Items:
    got = part.toArrow()
    return Items(got.column("id").to_pylist(), got.column("text"), window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD) -> DataFrame:
    """id, n_words, spans (start and end of maximal stretches of hit words, from word 0) and items (ids, in order) of every document."""
    small_batches(docs.sparkSession)
    parts = shards(benchmark, shard, item_col, item_text)
    if len(parts) < 2:
        return _searched(docs, [id_col], text_col, _items(parts[0], window) if parts else None)
    ws = Workspace(docs.sparkSession, "leaks")
    rows = ws.save(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    every = ws.save(_searched(rows, ["row", "id"], "text", _items(parts[0], window)), "first")
    found = [every] + [ws.save(_searched(rows, ["row"], "text", _items(part, window)).where("size(items) > 0"), "more") for part in parts[1:]]
    hits = reduce(DataFrame.union, [f.where("size(items) > 0").select("row", "spans", "items") for f in found])
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    return every.join(hits, "row", "left").select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce(_merged(F.col("s")), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("i", F.array().cast("array<string>")).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: float = 0.0, id_col: str = "doc_id") -> DataFrame:
    """docs without those of whose words more than a share of most is hit; every row of an id that has such a row goes."""
    found = contamination(docs, benchmark, id_col=id_col)
    bad = found.where(hit_words(F.col("spans")) > most * F.col("n_words")).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("_bad")), "left_anti")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH
item AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
placed AS (SELECT id, w, least(len(w), {WINDOW}) AS m, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT id, m, array_to_string(w[s + 1:s + m], ' ') AS g FROM placed),
doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
word AS (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS s FROM doc),
ahead AS (SELECT r, s, [{", ".join(f"lead(t, {i}) OVER x" for i in range(WINDOW))}] AS w FROM word WINDOW x AS (PARTITION BY r ORDER BY s)),
gram AS (SELECT r, s, m, array_to_string(w[1:m], ' ') AS g FROM ahead, (SELECT DISTINCT m FROM win) WHERE w[m] IS NOT NULL),
occ AS MATERIALIZED (SELECT r, s, m, id FROM gram JOIN win USING (m, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + m)) AS p FROM occ) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
