"""WARC archives of pages, and a capture index by external merge.

Writing: each page is a WARC/1.0 record of an HTTP response. Of pages with equal
payloads of at least LEAST_REVISIT bytes, that with the least page_id is the
response and the others are revisit records that refer to it and hold the HTTP
head alone. Each record is a gzip member of its own, as readers that seek need
it. Members are text rows for Spark's writer, on whatever store it writes to,
one file per task; the line end between them is an empty member, which readers
pass over, and which is kept out of the members themselves. A member's header
says where in its file it begins.

Reading: Spark's reader cuts the files at the empty members, so a large archive
is read by many tasks. The digest of each response is taken anew.

Index: an archive's captures are sorted by URL key, time and page into runs of
at most RUN captures, and the runs are merged by range of key and time: there
are as many ranges as keep each at about RANGE captures, and a task merges its
range of all runs with a loser tree that holds one capture per run. A URL with
any share of all captures is cut into ranges by time and page. The partitions
in order are the globally ordered capture histories, with each record's file,
offset and length.

Defined results: null html is an empty payload; a null url is written as the
record's own name; a null page_id is written as such, and its page refers to an
equal page that has one; repeated rows of one page_id and payload are all of
the same type; payloads of any length are written and read whole; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import BLOCK
from .workspace import Workspace, small_batches

LEAST_REVISIT = 100
BREAK = "\r\n\r\n"
#: An empty gzip member, the line end of archives.
GAP = bytes.fromhex("1f8b080000000000000303000000000000000000")
#: Captures of a run, and of the range of all runs that a task merges.
RUN, RANGE = 20_000, 100_000
#: Capture times of pages, which have none: seconds of their page_id after this one.
EPOCH = 1704067200
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One row per page with its WARC record as string ``value``, without the breaks that end it."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = same.where("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(same, "digest", "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    at = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(31_536_000)))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(BREAK))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    target = F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.translate(name(F.col("page_id")), "<>", ""))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Date: "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(BREAK), block).alias("value"))


def member(record: bytes, offset: int) -> bytes:
    """A gzip member whose header says at which byte of its file it begins."""
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"at", 8, offset)
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_FIXED), (6, zlib.Z_HUFFMAN_ONLY), (1, zlib.Z_RLE), (9, zlib.Z_FILTERED)):
        packer = zlib.compressobj(level, zlib.DEFLATED, -15, 9, strategy)
        out = head + packer.compress(record) + packer.flush() + tail
        if GAP not in out:  # what a stored stretch could hold
            return out
    raise ValueError("a record that holds the line end of archives however it is compressed")


def unpacked(piece: bytes) -> tuple[int, bytes]:
    """(offset, record) of a member."""
    return struct.unpack_from("<Q", piece, 16)[0], zlib.decompress(piece, 31)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, size, held = 0, 0, []
    for batch in batches:
        for value in batch.column(0):
            held.append(member(value.as_buffer().to_pybytes() + BREAK.encode(), at))
            at += len(held[-1]) + len(GAP)
            size += len(held[-1])
            if size > BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                size, held = 0, []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])


def _lines(options):
    return options.option("lineSep", GAP.decode("latin-1")).option("encoding", "ISO-8859-1")


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Archives of the pages below path, one per partition."""
    small_batches(pages.sparkSession)
    packed = records(pages, least).mapInArrow(_pack, "value binary").select(F.col("value").cast("string").alias("value"))
    _lines(packed.write).option("maxRecordsPerFile", 0).text(path)


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a header block; its first line is left out."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and query; no scheme, leading www or fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    labels = rest[:cut].lower().split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (rest[cut:] or "/")


_RUN = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in _RUN.split(", ")]


def _page(name: str) -> int | None:
    text = name.strip("<>").rsplit(":", 1)[-1]
    return None if text == "null" else int(text)


def _capture(file: str, piece: bytes) -> tuple:
    at, record = unpacked(piece)
    end = BREAK.encode()
    top, _, rest = record.partition(end)
    head = fields(top)
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(end)
    size, digest = int(fields(http)["content-length"]), head["warc-payload-digest"].partition(":")[2]
    if rest[len(block) :] != end or head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the record at byte {at} of {file} does not hold the payload it names")
    refers = head.get("warc-refers-to")
    return (url_key(head["warc-target-uri"]), head["warc-date"], _page(head["warc-record-id"]), size, digest, head["warc-type"], refers and _page(refers), file, at, len(piece))


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows: list[tuple], run: int) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([run] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32())], [*_NAMES, "run", "nth"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of captures, each of one archive and of RUN at most."""
    held: list[tuple] = []
    number = 0
    for batch in batches:
        for path, value in zip(batch.column(0), batch.column(1)):
            file = path.as_py()
            if held and (held[-1][7] != file or len(held) == RUN):
                yield _batch(sorted(held, key=_order), number)
                held, number = [], number + 1
            piece = value.as_buffer().to_pybytes() if value.is_valid else b""
            if piece:
                held.append(_capture(file, piece))
    if held:
        yield _batch(sorted(held, key=_order), number)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path, in runs (run: its number in the task part, nth: its place in the run)."""
    rows = _lines(spark.read).text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("value"))
    runs = rows.mapInArrow(_runs, f"{_RUN}, run int, nth int").withColumn("part", F.spark_partition_id())
    return runs.select(*_NAMES, F.struct("part", "run").alias("run"), "nth")


def merge(runs: list[Iterable], key=_order) -> Iterator:
    """k-way merge of sorted runs by a tree of losers: each step replays one path from leaf to root. One item of each run is held."""
    k = max(1, len(runs))
    last = (chr(0x10FFFF) * 2,)
    sources = [iter(r) for r in runs] or [iter(())]
    items: list = [None] * k
    heads: list = [None] * k

    def draw(i: int) -> None:
        for items[i] in sources[i]:
            heads[i] = key(items[i])
            return
        heads[i] = last

    for i in range(k):
        draw(i)
    tree = [-1] * k  # tree[0] is the winner, the others hold the losers of their games

    def play(i: int) -> None:
        node, winner = (i + k) // 2, i
        while node > 0:
            rival = tree[node]
            if rival < 0:
                tree[node] = winner
                return
            if (heads[rival], rival) < (heads[winner], winner):
                tree[node], winner = winner, rival
            node //= 2
        tree[0] = winner

    for i in range(k):
        play(i)
    while heads[tree[0]] is not last:
        w = tree[0]
        yield items[w]
        draw(w)
        node, winner = (w + k) // 2, w
        while node > 0:
            rival = tree[node]
            if (heads[rival], rival) < (heads[winner], winner):
                tree[node], winner = winner, rival
            node //= 2
        tree[0] = winner


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a range's runs, which come one after the other, each in its own order. They stay Arrow columns; the tree holds a key of each."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    part, run = (table["run"].combine_chunks().field(i).to_numpy() for i in range(2))
    cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (run[1:] != run[:-1])) + 1).tolist(), len(table)]

    def keys(lo: int, hi: int) -> Iterator[tuple]:
        for a in range(lo, hi, 256):
            rows = table.slice(a, min(256, hi - a))
            for i, row in enumerate(zip(*(rows[c].to_pylist() for c in _NAMES))):
                yield _order(row), a + i

    order: list[int] = []
    for _, row in merge([keys(a, b) for a, b in zip(cuts, cuts[1:])], key=lambda x: x[0]):
        order.append(row)
        if len(order) == 10_000:
            yield from table.select(_NAMES).take(pa.array(order)).combine_chunks().to_batches()
            order = []
    if order:
        yield from table.select(_NAMES).take(pa.array(order)).combine_chunks().to_batches()


def capture_index(runs: DataFrame, range_size: int = RANGE) -> DataFrame:
    """All captures, merged from runs; partitions are consecutive ranges in order."""
    ranges = max(1, -(-runs.count() // range_size))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "archive", "offset")
    return dealt.sortWithinPartitions("run", "nth").mapInArrow(_merge_range, _RUN)


def archive(pages: DataFrame, least: int = LEAST_REVISIT, range_size: int = RANGE, ws: Workspace | None = None) -> DataFrame:
    """Writes the pages to archives, reads them back and returns the merged capture index."""
    spark = pages.sparkSession
    ws = ws or Workspace(spark, "warc")
    path = ws.path("archives")
    write(pages, path, least)
    return capture_index(ws.save(read_runs(spark, path), "runs"), range_size)


ORACLE = """
WITH sized AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
same AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, s.payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM sized s LEFT JOIN same ON s.payload_digest = same.payload_digest"""
