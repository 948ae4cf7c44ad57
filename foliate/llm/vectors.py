"""Embedding near-duplicates by random-hyperplane sign hashing.

A vector's sketch is the signs of its products with random hyperplanes, some
bits for each of several tables; vectors with the same bits in a table share a
bucket. The bits per table grow with the logarithm of the number of rows, so
that a bucket's expected size stays fixed, and the number of tables follows
from the wanted recall at the threshold: at any size a pair of exactly the
threshold's cosine is found with the same probability.

Equal vectors are one class with a count, so a very common vector is compared
once. Tables deal out ids with their sketches, not vectors. A bucket goes in
blocks of bounded size, and pairs of blocks are screened by the bits in which
sketches differ: a pair at the threshold passes but for six standard
deviations. Only vectors with a partner left fetch their components, and meet
as matrices in double precision. No task holds a whole bucket and no pairs are
emitted: a block pair returns, for each vector, how many links it has there and
one edge towards its component. A pair that meets in several tables counts in
the first of them only, which both sketches tell.

Defined results: vectors that are null, zero, or hold a null or non-finite
component link with nothing, nor do vectors of unequal length; a null vec_id is
returned with no links, a null component and kept true; rows that repeat a
vec_id are one node, of the first vector in order of its components, and each
get its result; vectors of any length are read whole; an empty table gives no
rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, least_reached
from .workspace import Workspace

COSINE = 0.9
RECALL = 0.999
#: Expected rows of a bucket, and the most that a block holds on average.
BUCKET, MEET = 512, 512
SEED = 20_240_917
#: Pairs looked at together once they have passed a screen.
PAIRS = 1 << 14


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits per table and number of tables for n rows."""
    bits = min(62, max(1, math.ceil(math.log2(max(2, n / bucket)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def most_unlike(bits: int, cosine: float) -> int:
    """Bits of a sketch in which a pair of this cosine differs at most, but for one in a thousand million."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def _hash(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column(1).cast(pa.list_(pa.float64()))
        lengths = np.diff(column.offsets.to_numpy())
        flat = np.nan_to_num(column.values.to_numpy(zero_copy_only=False), nan=0.0)
        starts = column.offsets.to_numpy()
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            x = flat[starts[rows][:, None] + np.arange(dim)[None]] + 0.0  # no negative zeros
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
            sketch = np.packbits(x @ planes[dim] >= 0, axis=1)
            columns = [pa.array([r.tobytes() for r in z], pa.binary()) for z in (x, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], ["vec_id", "vector", "sketch"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sides(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """A row for each table: t, key, dim, vec_id, sketch."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.unpackbits(_sketches(batch.column(2)), axis=1)[:, : bits * tables].reshape(-1, tables, bits)
        for t in range(tables):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array((signs[:, t] * weights).sum(1, dtype=np.int64)), batch.column(1), batch.column(0), batch.column(2)],
                ["t", "key", "dim", "vec_id", "sketch"],
            )


_PLACE = ["t", "key", "dim", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The block pairs of rows that come in order of _PLACE."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _PLACE])
        if held and (place[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = place[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _first_meeting(p: np.ndarray, q: np.ndarray, sketch: np.ndarray, t: int, bits: int, tables: int) -> np.ndarray:
    """Whether table t is the first in which the pairs (p, q) agree."""
    differ = np.unpackbits(sketch[p] ^ sketch[q], axis=1)[:, : bits * tables].reshape(len(p), tables, bits).any(axis=2)
    return (~differ).argmax(axis=1) == t


def _sides_of(group: pa.Table) -> tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]:
    """(table, one block with itself, ids, rows of the left block, rows of the right)."""
    t, i, j = (group[c][0].as_py() for c in ("t", "i", "j"))
    block = group["block"].to_numpy()
    return t, i == j, group["vec_id"].to_numpy(), np.flatnonzero(block == i), np.flatnonzero(block == j)


def _screen(batches: Iterator[pa.RecordBatch], bits: int, tables: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of each block pair that have a partner there whose sketch is like theirs."""
    names = [*_PLACE, "block", "vec_id"]
    for group in _groups(batches):
        t, within, ids, left, right = _sides_of(group)
        sketch = _sketches(group["sketch"].combine_chunks())
        wide = np.zeros((len(ids), -(-sketch.shape[1] // 8) * 8), np.uint8)
        wide[:, : sketch.shape[1]] = sketch
        wide = wide.view(np.uint64)
        found = np.zeros(len(ids), bool)
        for lo in range(0, len(left), MEET):
            part = left[lo : lo + MEET]
            unlike = np.zeros((len(part), len(right)), np.uint16)
            for w in range(wide.shape[1]):
                unlike += np.bitwise_count(wide[part, w][:, None] ^ wide[right, w][None])
            near = unlike <= most
            if within:
                near &= ids[part][:, None] < ids[right][None]
            a, b = np.nonzero(near)
            for k in range(0, len(a), PAIRS):
                p, q = part[a[k : k + PAIRS]], right[b[k : k + PAIRS]]
                on = _first_meeting(p, q, sketch, t, bits, tables)
                found[p[on]] = found[q[on]] = True
        if found.any():
            yield from group.select(names).filter(pa.array(found)).combine_chunks().to_batches()


def _meet(batches: Iterator[pa.RecordBatch], bits: int, tables: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a bucket, or within one: per vector a count and an edge to a lesser vec_id."""
    for group in _groups(batches):
        t, within, ids, left, right = _sides_of(group)
        sketch, n = _sketches(group["sketch"].combine_chunks()), group["n"].to_numpy()
        x = np.frombuffer(b"".join(group["vector"].to_pylist())).reshape(len(ids), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        links, low, up = np.zeros(len(ids), np.int64), [], []
        for lo in range(0, len(left), MEET):
            part = left[lo : lo + MEET]
            near = x[part] @ x[right].T >= cosine - 1e-12
            if within:
                near &= ids[part][:, None] < ids[right][None]
            a, b = np.nonzero(near)
            for k in range(0, len(a), PAIRS):
                p, q = part[a[k : k + PAIRS]], right[b[k : k + PAIRS]]
                on = (x[p] * x[q]).sum(axis=1) >= cosine
                on[on] = _first_meeting(p[on], q[on], sketch, t, bits, tables)
                p, q = p[on], q[on]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                low.append(p)
                up.append(q)
        if not links.any():
            continue
        order = np.argsort(ids)
        rank = np.argsort(order)  # a lesser vec_id has a lesser rank
        root = ids[order[least_reached(rank[np.concatenate(low)], rank[np.concatenate(up)], len(ids))[rank]]]
        on = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), pa.array(root[on])], ["vec_id", "links", "root"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED, meet: int = MEET, ws: Workspace | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of vectors."""
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "vectors")
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    bits, tables = plan(usable.select("vec_id").distinct().count(), cosine, recall)
    hashed = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    hashed = hashed.mapInArrow(lambda it: _hash(it, bits, tables, seed), "vec_id long, vector binary, sketch binary")
    hashed = ws.save(hashed.withColumn("digest", F.unhex(F.substring(F.sha2("vector", 256), 1, 32))), "hashed")
    # equal vectors, known by 128 bits of their SHA-256, are one class
    classes = ws.save(hashed.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    members = ws.save(hashed.select("vec_id", "digest").hint("merge").join(classes, "digest").select("vec_id", "rep", "n"), "members")
    reps = ws.save(hashed.select("vec_id", "vector", "sketch").join(classes.select(F.col("rep").alias("vec_id"), "n"), "vec_id"), "representatives")
    sides = reps.select("vec_id", F.length("vector").alias("dim"), "sketch").mapInArrow(lambda it: _sides(it, bits, tables), "t int, key long, dim int, vec_id long, sketch binary")
    full = sides.groupBy("t", "key", "dim").agg(F.count("*").alias("n")).where("n > 1")
    full = ws.save(full.select("t", "key", "dim", F.ceil(F.col("n") / meet).cast("int").alias("blocks")), "buckets")
    met = sides.join(full, ["t", "key", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*_PLACE, "block", "vec_id", "sketch")
    most = most_unlike(bits * tables, cosine)
    met = met.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    near = ws.save(met.mapInArrow(lambda it: _screen(it, bits, tables, most), "t int, key long, dim int, i int, j int, block int, vec_id long"), "screened")
    found = near.join(reps, "vec_id").repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    found = ws.save(found.mapInArrow(lambda it: _meet(it, bits, tables, cosine), "vec_id long, links long, root long"), "found")
    group = components(ws, found.select("vec_id", "root"))
    ws.only(members, found, group)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = members.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(group.toDF("rep", "component"), "rep", "left")
    known = known.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    return (
        vectors.select("vec_id")
        .join(known, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            (F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True))).alias("kept"),
        )
    )


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node),
groups AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN groups ON node = v.vec_id LEFT JOIN degrees ON a = v.vec_id"""
