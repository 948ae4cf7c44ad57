"""Exact repeated passages by a sparse suffix array.

A suffix is retained only where its first GRAM words are the minimiser of some
window of LENGTH words: the least hash of all the window's grams, the leftmost
of equals. Which suffixes are retained thus depends on content alone, so equal
windows retain the same suffix at the same place. Every window belongs to one
retained suffix; the windows of a suffix lie side by side and span its context.

1. Copies of a whole context fall together under 128 bits of its words' digest,
   by partial aggregates, so a passage in thousands of documents goes on once.
2. Contexts whose suffixes start with the same gram are sorted: the suffixes by
   the words from the gram on, and the words before it from the gram back.
   Neighbours in either order are compared word by word, which gives the longest
   common prefixes, and with them the extension of every match to the right and
   to the left. For each place a that the gram can have in a window, suffixes
   between which no prefix is shorter than LENGTH - a to the right and a to the
   left hold the same window. So a match is seen however far apart its suffixes
   sort, and no pairs are made.
3. A gram with more than MOST contexts, such as a line that very many documents
   share among unlike words, does not go to one task: its windows meet one by
   one, under digests of their words.

The result is exact: a word is repeated if, and only if, it lies in a window of
LENGTH words that occurs elsewhere too. The first place of each window, by
doc_id, version and position, is the one that stays. The version is a hash of
the text: with the doc_id it says which text a place is in.

Defined results: null, empty and shorter texts have no windows and stay as they
are; rows with the same doc_id count as one document if their texts are equal,
and get the same spans, else as documents of their own; rows with a null doc_id
are left as they are and match nothing; texts of any length are read whole; an
empty table gives no rows; other columns are kept as they are, and their names
may be any.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import U, Runs, Words, blocks
from .workspace import Workspace

LENGTH = 50
GRAM = 12
#: Contexts of one gram that one task sorts, and rows it sorts at a time.
MOST, PORTION = 500, 4000


def minimisers(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram's hash, position of the retained suffix, its first window, its last window), positions over the block's words."""
    n = len(words.doc)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none, none
    g = Runs(words.hashes()).fixed(gram)
    order = np.where(words.doc[: len(g)] == words.doc[gram - 1 :], g, U(2**64 - 1))
    least, have, span = np.arange(len(g)), 1, length - gram + 1
    while have < span:  # the least of ever wider windows, the left one of equals
        step = min(have, span - have)
        a, b = least[:-step], least[step:]
        least = np.where(order[a] <= order[b], a, b)
        have += step
    start = np.flatnonzero(words.doc[: n - length + 1] == words.doc[length - 1 :])
    at = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return words.doc[start[first]], g[at[first]], at[first], start[first], start[last]


def _version(text) -> Column:
    return F.xxhash64(text)


def _digests(words: Words, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits of the words from each start up to its end."""
    text, at = words.spaced()
    return [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(at[starts].tolist(), at[ends].tolist())]


def _retain(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(2)):
            words = Words(data, offsets)
            doc, g, at, s, e = minimisers(words, length, gram)
            if not len(doc):
                continue
            base = words.first[doc]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g.view(np.int64)),
                    pa.array(_digests(words, s, e + length), pa.binary()),
                    *(batch.column(i).slice(lo, hi - lo).take(pa.array(doc)) for i in range(2)),
                    pa.array((s - base).astype(np.int32)),
                    pa.array((e - base).astype(np.int32)),
                    pa.array((at - s).astype(np.int32)),
                ],
                ["gram", "context", "doc_id", "version", "first", "last", "lead"],
            )


_SPAN = ["first", "last", "lead", "several", "gram", "hot"]


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words of the spans of (doc_id, version, text, spans): one row per context, or per window where its gram is hot."""
    for batch in batches:
        spans = batch.column(3)
        for lo, hi, data, offsets in blocks(batch.column(2)):
            words = Words(data, offsets)
            part = spans.slice(lo, hi - lo)
            doc = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
            flat = part.flatten()
            first, last, lead, several, gram, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(len(_SPAN)))
            text, at = words.spaced()
            for on, wide in ((np.flatnonzero(~hot), False), (np.flatnonzero(hot), True)):
                if not len(on):
                    continue
                if wide:  # a row for each window
                    n = (last[on] - first[on] + 1).astype(np.int64)
                    row = np.repeat(on, n)
                    a = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[on], n)
                    b = a
                else:
                    row, a, b = on, first[on], last[on]
                base = words.first[doc[row]]
                span = zip(at[base + a].tolist(), (at[base + b + length] - 1).tolist())
                cut = [text[x:y] for x, y in span]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[row]),
                        pa.array([blake2b(x, digest_size=16).digest() for x in cut] if wide else [None] * len(cut), pa.binary()),
                        *(batch.column(i).slice(lo, hi - lo).take(pa.array(doc[row])) for i in range(2)),
                        pa.array(a.astype(np.int32)),
                        pa.array(b.astype(np.int32)),
                        pa.array(lead[row]),
                        pa.array(several[row], pa.bool_()),
                        pa.array([None] * len(cut) if wide else cut, pa.binary()),
                    ],
                    ["gram", "window", "doc_id", "version", "first", "last", "lead", "several", "words"],
                )


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows of word numbers, which are above 0 and end in zeros; words each has in common with the row before it)."""
    n, width = rows.shape
    if not width:
        return np.arange(n), np.zeros(n, np.int64)
    order = np.argsort(rows.astype(">u4").view(f"S{4 * width}").ravel(), kind="stable")
    z = rows[order]
    same = np.zeros((n, width + 1), bool)
    same[1:, :width] = (z[1:] == z[:-1]) & (z[1:] > 0)
    return order, same.argmin(axis=1)


def _matches(table: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """Windows that several contexts of a gram hold, and those of contexts that occur several times: ranges, kept or not."""
    ids, version = table["doc_id"].to_numpy(), table["version"].to_numpy()
    first, last, lead = (table[c].to_numpy().astype(np.int64) for c in ("first", "last", "lead"))
    place = np.lexsort([first + lead, version, ids])
    new = np.ones(len(place), bool)  # rows that repeat a document repeat its contexts
    new[1:] = (np.diff(ids[place]) != 0) | (np.diff(version[place]) != 0) | (np.diff((first + lead)[place]) != 0)
    place = place[new]
    table, ids, version, first, last, lead = table.take(pa.array(place)), ids[place], version[place], first[place], last[place], lead[place]
    several = table["several"].to_numpy(zero_copy_only=False).astype(bool)
    _, _, data, offsets = next(blocks(table["words"].combine_chunks(), 1 << 62))
    words = Words(data, offsets)
    number = np.concatenate([words.numbers() + 1, [0]])  # 0: no word
    n, at = len(ids), words.first[:-1] + lead
    right = at[:, None] + np.arange(length)[None]
    right = number[np.where(right < words.first[1:, None], right, -1)]
    left = at[:, None] - 1 - np.arange(length - gram)[None]
    left = number[np.where(left >= words.first[:-1, None], left, -1)]
    by_right, right_common = _sorted(right)
    by_left, left_common = _sorted(left)
    # per context and place of the gram in a window: 0 nothing, 1 first place, 2 later place
    said = np.zeros((n, length - gram + 2), np.int8)
    group_r, group_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(length - gram + 1):
        on = np.flatnonzero((a <= lead) & (a >= lead - (last - first)))
        if not len(on):
            continue
        group_r[by_right] = np.cumsum(right_common < length - a)
        group_l[by_left] = np.cumsum(left_common < a)
        _, least, which, count = np.unique(group_r[on] * (n + 1) + group_l[on], return_index=True, return_inverse=True, return_counts=True)
        shared = count[which] > 1
        said[on, a] = np.where(shared, np.where(least[which] == np.arange(len(on)), 1, 2), several[on])
    flat = said.ravel()  # a column of zeros ends each row
    change = np.concatenate([[True], flat[1:] != flat[:-1]])
    begin = np.flatnonzero(change)
    stop = np.concatenate([begin[1:], [len(flat)]])
    begin, stop = begin[flat[begin] > 0], stop[flat[begin] > 0]
    row, low = np.divmod(begin, said.shape[1])
    high = low + (stop - begin) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[row]),
            pa.array(version[row]),
            pa.array((first + lead)[row] - high, pa.int32()),
            pa.array((first + lead)[row] - low, pa.int32()),
            pa.array(flat[begin] == 1),
        ],
        ["doc_id", "version", "first", "last", "kept"],
    )


def _neighbours(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts that come in order of gram, some thousand at a time and a gram's all at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if sum(b.num_rows for b in held) >= PORTION:
            start = int(np.searchsorted(key != held[-1].column(0)[-1].as_py(), True))  # of the next gram
            if start < len(key):
                yield _matches(pa.Table.from_batches([*held, batch.slice(0, start)]), length, gram)
                held, batch = [], batch.slice(start)
        held.append(batch)
    if held:
        yield _matches(pa.Table.from_batches(held), length, gram)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, ws: Workspace | None = None) -> DataFrame:
    """doc_id, version, first, last, kept: ranges of windows that occur again. kept: it is the first place of these windows."""
    ws = ws or Workspace(docs.sparkSession, "suffixes")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null").select("doc_id", _version("text").alias("version"), "text")
    kept = texts.mapInArrow(lambda it: _retain(it, length, gram), "gram long, context binary, doc_id long, version long, first int, last int, lead int")
    kept = ws.save(kept, "suffixes")
    place = F.struct("doc_id", "version", "first", "last", "lead")
    same = kept.groupBy("gram", "context").agg(F.min(place).alias("p"), F.max(place).alias("q"))
    # rows that repeat a document repeat its places too
    same = ws.save(same.select("gram", "context", "p", F.expr("(p.doc_id, p.version, p.first) <> (q.doc_id, q.version, q.first)").alias("several")), "contexts")
    # copies of a context, all but the first of each
    whole = kept.hint("merge").join(same.where("several").select("gram", "context", "p"), ["gram", "context"])
    whole = whole.where("(doc_id, version, first) <> (p.doc_id, p.version, p.first)").select("doc_id", "version", "first", "last", F.lit(False).alias("kept"))
    # grams with several contexts: the first member of each context meets those of the others
    grams = same.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1")
    grams = ws.save(grams.select("gram", (F.col("contexts") > most).alias("hot")), "grams")
    alone = same.where("several").join(grams, "gram", "left_anti").select("p.doc_id", "p.version", "p.first", "p.last", F.lit(True).alias("kept"))
    open_spans = same.join(grams, "gram").select("p.doc_id", "p.version", F.struct("p.first", "p.last", "p.lead", "several", "gram", "hot").alias("span"))
    by_doc = open_spans.groupBy("doc_id", "version").agg(F.collect_list("span").alias("spans"))
    # equal texts of one doc_id are one
    rows = texts.hint("merge").join(by_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "spans")
    schema = "gram long, window binary, doc_id long, version long, first int, last int, lead int, several boolean, words binary"
    found = ws.save(rows.mapInArrow(lambda it: _contexts(it, length), schema), "open")
    ranges = "doc_id long, version long, first int, last int, kept boolean"
    near = found.where("words is not null").select("gram", "doc_id", "version", "first", "last", "lead", "several", "words")
    near = near.repartition("gram").sortWithinPartitions("gram").mapInArrow(lambda it: _neighbours(it, length, gram), ranges)
    hot = found.where("words is null").select("window", "doc_id", "version", "first", "several")
    again = hot.groupBy("window").agg(F.count_distinct("doc_id", "version", "first").alias("n"), F.min(F.struct("doc_id", "version", "first")).alias("p")).where("n > 1")
    again = ws.save(again.select("window", "p"), "repeated-windows")  # so that Spark can split a window that very many documents share
    single = hot.join(again, "window", "left").where("several or p is not null")
    single = single.select("doc_id", "version", "first", F.col("first").alias("last"), F.expr("p is null or (doc_id, version, first) = (p.doc_id, p.version, p.first)").alias("kept"))
    out = ws.save(whole.union(alone).union(near).union(single), "repeats")
    ws.only(out)
    return out


def _spans(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _merged(first: np.ndarray, last: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges covered by the windows, joined where they touch."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, np.minimum(last + length, n), -1)
    on = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return edge[::2], edge[1::2]


def _ranges(batch: pa.RecordBatch, at: int, length: int) -> Iterator[tuple]:
    """Per text: (its bytes, its words' starts and ends within them, word ranges)."""
    spans = batch.column(batch.num_columns - 1)
    for lo, hi, data, offsets in blocks(batch.column(at)):
        part = spans.slice(lo, hi - lo)
        stops = np.concatenate([[0], np.cumsum(np.diff(part.offsets.to_numpy()))])
        flat = part.flatten()
        first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        words = Words(data, offsets)
        for d in range(hi - lo):
            own, at_words = slice(stops[d], stops[d + 1]), slice(words.first[d], words.first[d + 1])
            merged = _merged(first[own], last[own], length, words.counts[d]) if stops[d + 1] > stops[d] else (first[:0], last[:0])
            text = data[offsets[d] : offsets[d + 1]]
            yield text, words.starts[at_words] - offsets[d], words.ends[at_words] - offsets[d], merged


def _list(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = [], batch.column(0)
        for i, (_, starts, ends, (a, b)) in enumerate(_ranges(batch, 1, length)):
            rows += [(i, x, y, int(starts[x]), int(ends[y - 1])) for x, y in zip(a.tolist(), b.tolist())]
        names = ["word_start", "word_end", "byte_start", "byte_end"]
        of, *columns = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5))
        yield pa.RecordBatch.from_arrays([ids.take(of), *columns, batch.column(2).take(of)], ["doc_id", *names, "kept"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new = []
        for text, starts, ends, (a, b) in _ranges(batch, at, length):
            cuts = [0, *(int(x) for pair in zip(starts[a], ends[b - 1]) for x in pair), len(text)] if len(a) else []
            whole = text.tobytes() if cuts else b""
            new.append(b"".join(whole[x:y] for x, y in zip(cuts[::2], cuts[1::2])).decode("utf-8", "replace") if cuts else None)
        text = batch.column(at)
        changed = pa.array([x is not None for x in new], pa.bool_())
        fresh = pc.if_else(changed, pa.array(new, pa.large_string()), text.cast(pa.large_string())).cast(text.type)
        yield pa.RecordBatch.from_arrays([fresh if i == at else c for i, c in enumerate(batch.columns[:-1])], batch.schema.names[:-1])


_EMPTY = "array<struct<first:int,last:int>>"


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, ws: Workspace | None = None) -> DataFrame:
    """One row per repeated passage: doc_id, word_start, word_end, byte_start, byte_end (ends past the last), kept.

    kept: the passage is the first place of its windows and stays; else it goes. Passages of one kind that touch are
    one. A document without repeats has no row.
    """
    ranges = repeats(docs, length, gram, most, ws)
    spans = ranges.groupBy("doc_id", "version", "kept").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("version", _version("text"))
    rows = rows.hint("merge").join(spans, ["doc_id", "version"]).select("doc_id", "text", "kept", "spans")
    return rows.mapInArrow(lambda it: _list(it, length), "doc_id long, word_start long, word_end long, byte_start long, byte_end long, kept boolean")


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, ws: Workspace | None = None) -> DataFrame:
    """docs with the repeated words cut out of the texts; white space around them stays."""
    key, version, extra = "_doc", "_version", "_spans"
    while {key, version, extra} & set(docs.columns):
        key, version, extra = key + "_", version + "_", extra + "_"
    spans = _spans(repeats(docs, length, gram, most, ws).where("not kept")).select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("spans").alias(extra))
    own = _version(F.col("text").cast("string"))
    rows = docs.hint("merge").join(spans, (F.col("doc_id") == F.col(key)) & (own == F.col(version)), "left").drop(key, version)
    rows = rows.withColumn(extra, F.coalesce(extra, F.array().cast(_EMPTY)))
    at = docs.columns.index("text")
    return rows.mapInArrow(lambda it: _cut(it, length, at), docs.schema)


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS gaps FROM documents WHERE doc_id IS NOT NULL),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS s FROM (SELECT DISTINCT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM cut WHERE len(ws) >= 50)),
firsts AS (SELECT s, min(struct_pack(d := doc_id, i := i)) AS p FROM windows GROUP BY s HAVING count(*) > 1),
marked AS (SELECT doc_id, i, doc_id = p.d AND w.i = p.i AS kept FROM windows w JOIN firsts USING (s)),
islands AS (
  SELECT *, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kept ORDER BY i) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, kept ORDER BY i) AS before FROM marked)),
spans AS (SELECT doc_id, kept, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, kept, island),
placed AS (SELECT *, len(ws) + 0 AS n, CASE WHEN regexp_matches(text, '^[\x20\x09-\x0D]') THEN 1 ELSE 0 END AS lead FROM spans JOIN cut USING (doc_id))
SELECT doc_id, a AS word_start, b AS word_end, kept,
  CAST(coalesce(list_sum(list_transform(ws[1:a], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(gaps[1:a + lead], lambda x: strlen(x))), 0) AS BIGINT) AS byte_start,
  CAST(list_sum(list_transform(ws[1:b], lambda x: strlen(x))) + coalesce(list_sum(list_transform(gaps[1:b - 1 + lead], lambda x: strlen(x))), 0) AS BIGINT) AS byte_end
FROM placed"""
