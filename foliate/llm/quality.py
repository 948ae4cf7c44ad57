"""Quality rules: counts over whole texts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1- and 2-grams are counted, one from trusted
target documents and one from the whole raw corpus (as in DSIR, Xie et al.,
2023). A document's score is the mean of log p_target / p_raw over its n-grams,
so length cancels; it is kept if no base rule fails it and its score is at
least a fixed threshold.

Both count tables have a fixed number of buckets, so what goes to the driver
and back to the executors is bounded whatever the corpus. Every trusted row
counts: texts meet the trusted ids in a shuffle join, so their number has no
bound. The raw counts and all scores cover every document.

Lines and windows of one text are equal if their bytes and words are; the
buckets of n-grams alone go by hash.

Defined results: a null, empty or wordless text has all counts 0, score 0 and
fails the base rules; without trusted rows every score is 0; a row with a null
doc_id is judged like any other and is never trusted; repeated rows each get
their result; a very long text is a block of its own and is read whole; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, Runs, Words, blocks, distinct, mix, repeated_runs
from .workspace import small_batches

BUCKETS = 1 << 16
THRESHOLD = -0.2
LEAST_WORDS = 20
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated_words(words: Words, k: int = WINDOW) -> np.ndarray:
    """Per text, the words inside k-word windows found twice or more in it."""
    at = repeated_runs(words, k)
    cover = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return np.bincount(words.doc[np.cumsum(cover)[:-1] > 0], minlength=words.n_docs)


def duplicate_lines(words: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    data, offsets = words.data, words.offsets
    brk = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], brk + 1]))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(data)]]), offsets[doc + 1]) if len(starts) else starts
    ends = ends - ((ends > starts) & (data[ends - 1] == 10))  # without the line feed
    some = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[some], ends[some], doc[some]
    line, _ = distinct(data, starts, ends)
    _, first = np.unique(line * words.n_docs + doc, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    return np.bincount(doc[again], minlength=words.n_docs)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over the texts."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base_counts(words: Words) -> dict[str, np.ndarray]:
    lead = (words.data & 0xC0) != 0x80  # first byte of a code point
    return {
        "n_words": words.counts,
        "word_chars": per_text(lead & words.solid, words.offsets),
        "n_symbols": per_text(SYMBOLS[words.data], words.offsets),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeated_words(words),
    }


def ngrams(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams, with the text each is of."""
    hashes = words.hashes()
    two = Runs(hashes).fixed(2)
    at = np.flatnonzero(words.doc[:-1] == words.doc[1:]) if len(two) else np.zeros(0, np.int64)
    h = np.concatenate([mix(hashes + U(0x51ED270B)), two[at]])
    return (h % U(buckets)).astype(np.int64), np.concatenate([words.doc, words.doc[at]])


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, buckets), np.int64)
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in blocks(batch.column(0)):
            words = Words(data, offsets)
            b, d = ngrams(words, buckets)
            sums[0] += np.bincount(b, minlength=buckets)
            on = trusted[lo:hi][d]
            if on.any():
                sums[1] += np.bincount(b[on], minlength=buckets)
    at = np.flatnonzero(sums[0])
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target / p_raw per bucket, from all of docs and those whose doc_id is in trusted."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # rows without doc_id are never trusted, and would all be dealt to one task
    marked = texts.where("doc_id is not null").join(ids.hint("shuffle_hash"), "doc_id", "left")
    marked = marked.unionByName(texts.where("doc_id is null"), allowMissingColumns=True)
    counts = (
        marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(lambda it: _count(it, buckets), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _judge(batches: Iterator[pa.RecordBatch], ratios: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            words = Words(data, offsets)
            c = base_counts(words)
            b, d = ngrams(words, len(ratios))
            total = np.bincount(d, weights=ratios[b], minlength=hi - lo)
            n = np.bincount(d, minlength=hi - lo)
            score = np.round(total / np.maximum(n, 1), 9)
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
            cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in c.values()), pa.array(failed)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(~failed & (score >= threshold)), pa.array(score)], ["doc_id", *c, "base_failed", "kept", "score"])


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, per row of docs."""
    small_batches(docs.sparkSession)
    ratios = log_ratios(docs, trusted, buckets)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _judge(it, ratios, threshold),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double",
    )
