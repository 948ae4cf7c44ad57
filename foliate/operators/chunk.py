"""Heading-scoped chunks with greedy merging and overlapping word windows.

A body is cut at headings of level 1 to 4. Neighbouring sections share a chunk
while their words fit; a section that alone is too long becomes windows of
max_words words that start every max_words - overlap words. Bodies that may be
long enough take one Arrow UDF that reads each once, so that time and memory
are in proportion to a body whatever its sections; others stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T

#: Fixed value. A heading starts a line; the white space behind its marks may cross a line feed.
HEADING = r"(?dm)^(#{1,4})\s+(.+)$"
_HEADING = re.compile(HEADING.replace("(?dm)", "(?m)").encode())
_A, _B, _C = "\x01\x02", "\x02\x03", "\x03\x01"
_SECTION = "array<struct<heading:string,level:int,content:string,n:bigint>>"


def sections(body: Column, preamble: str = Config.preamble) -> Column:
    """Non-empty sections in order: heading, level, content, n (words). Text before the first heading has the preamble's name."""
    marked = F.regexp_replace(body, HEADING, f"{_A}$1{_B}$2{_C}")
    parts = F.split(marked, _A)

    def one(p: Column, i: Column) -> Column:
        head, content = F.substring_index(p, _C, 1), T.strip(F.substr(p, F.locate(_C, p) + 2))
        first = T.strip(p)
        content = F.when(i == 0, first).otherwise(content)
        return F.struct(
            F.when(i == 0, F.lit(preamble)).otherwise(T.strip(F.substr(head, F.locate(_B, head) + 2))).alias("heading"),
            F.when(i == 0, F.lit(1)).otherwise(F.length(F.substring_index(head, _B, 1))).cast("int").alias("level"),
            content.alias("content"),
            T.word_count(content).alias("n"),
        )

    return F.filter(F.transform(parts, one), lambda s: s["content"] != "").cast(_SECTION)


def _greedy(counts: Iterable[int], most: int) -> Iterator[int]:
    """Chunk number of each section, from 1: a section joins the open chunk while the words fit; one too long stands alone."""
    number = words = 0
    for n in counts:
        if words > 0 and words + n <= most:
            words += n
        else:
            number, words = number + 1, n if n <= most else 0
        yield number


def fold(counts: Column, max_words: int) -> Column:
    """Chunk numbers (array) of a body's sections from their words (array of bigint)."""

    @F.arrow_udf("array<int>")
    def numbers(column: pa.Array) -> pa.Array:
        return pa.array([None if c is None else list(_greedy(c, max_words)) for c in column.to_pylist()], pa.list_(pa.int32()))

    return numbers(counts)


def windows(words: Column, size: int, overlap: int) -> Column:
    """Array of word arrays: size words from every (size - overlap)-th word."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(size)))


def _cut(body: bytes, config: Config) -> list[tuple[str, bytes]]:
    """(section, content) of a body's chunks; words are what ASCII white space parts."""
    parts, at, heading = [], 0, config.preamble
    for m in [*_HEADING.finditer(body), None]:
        if content := body[at : m.start() if m else len(body)].strip():
            parts.append((heading, content, len(content.split())))
        if m:
            at, heading = m.end(), m[2].strip().decode()
    out, last, step = [], 0, config.max_chunk_words - config.chunk_overlap_words
    for (name, content, n), number in zip(parts, _greedy((n for _, _, n in parts), config.max_chunk_words)):
        if n > config.max_chunk_words:
            words = content.split()
            for i, start in enumerate(range(0, n, step)):
                label = f"{name} ({config.part_label} {i + 1})" if i else name
                out.append((label, [b" ".join(words[start : start + config.max_chunk_words])]))
        elif number == last:
            out[-1][1].append(content)
        else:
            out.append((name, [content]))
        last = number
    return [(name, b"\n\n".join(contents)) for name, contents in out]


_CHUNK = pa.struct([("section", pa.string()), ("content", pa.string())])


def _chunks(config: Config):
    @F.arrow_udf("array<struct<section:string,content:string>>")
    def cut(column: pa.Array) -> pa.Array:
        """The chunks of each body, or null if it stays whole."""
        ends, names, contents, whole = [0], [], [], []
        for body in column.cast(pa.binary()):
            body = body.as_py()
            chunks = _cut(body, config) if body is not None and len(body.split()) > config.max_chunk_words else []
            whole.append(len(chunks) < 2)
            if not whole[-1]:
                names += [name for name, _ in chunks]
                contents += [content for _, content in chunks]
            ends.append(len(names))
        structs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary()).cast(pa.string())], fields=list(_CHUNK))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=pa.array(whole, pa.bool_()))

    return cut


def chunk_rows(pages: DataFrame, config: Config = Config(), body: str = "body") -> DataFrame:
    """pages with chunk_index, chunk_total, section and content: one row per chunk.

    A page that is short, or makes no more than one chunk, stays whole: 1 of 1, no section, its body unmodified.
    """
    names = [c for c in pages.columns if c not in ("chunk_index", "chunk_total", "section", "content")]
    rows = pages.withColumn("_text", F.coalesce(F.col(body), F.lit("")))
    # n words and what parts them have 2n - 1 characters at least
    long = F.when(F.length("_text") > 2 * config.max_chunk_words, F.col("_text"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("section"), F.col("_text").alias("content")))
    rows = rows.withColumn("_chunks", F.coalesce(_chunks(config)(long), whole))
    # never empty; the outer form keeps the optimizer from filtering on the whole chain of expressions once more
    rows = rows.withColumn("chunk_total", F.size("_chunks").cast("bigint")).select("*", F.posexplode_outer("_chunks").alias("_i", "_c"))
    return rows.select(*names, (F.col("_i") + 1).cast("bigint").alias("chunk_index"), "chunk_total", F.col("_c.section").alias("section"), F.col("_c.content").alias("content"))
