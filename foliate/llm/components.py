"""Connected components of an edge table, without gathering any node's neighbours.

Alternating large-star and small-star steps (Kiveris et al., 2014): each links
the neighbours of a node with the least of them. Minima are partial
aggregates and the rest are plain joins, so a node with a third of all edges
is summed map-side and its join partition is split at run time. After each
step the edges of a partition are replaced by stars around the least nodes
they reach within it, so paths inside a partition cost no further steps. Edges
are dealt to as few partitions as TASK_EDGES allows for that, so a table that
fits one of them is done in a single pass, and larger ones in fewer steps.

Defined results: loops, repeated edges and either order of a pair are fine; an
edge with a null end joins nothing; nodes without edges have no row; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Edges that a task puts together to stars on average, some 50 bytes each.
TASK_EDGES = 500_000


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each node 0 .. n-1 the least node it reaches over the edges (a, b)."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, least[a], low)
        np.minimum.at(new, least[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    return least


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(2))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = least_reached(at[: len(a)], at[len(a) :], len(nodes))
        on = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[least[on]])], held[0].schema.names)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b, distinct). Every neighbour of a node is linked with the least of node and neighbours."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # neighbours above the node
        linked = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = linked.union(least.select("a", F.col("m").alias("b")))
    return linked.where("a > b").distinct()


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component): of each node of an edge, the least node it reaches. edges: two columns of one integer type."""
    a, b = edges.columns
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct()
    now, whole = _stars(ws, now)
    while not whole and not _settled(now):
        after, whole = _stars(ws, _star(_star(now, True), False))
        ws.drop(now)
        now = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").toDF("node", "component").distinct())
    return ws.named_as(now, found)


def _stars(ws: Workspace, edges: DataFrame) -> tuple[DataFrame, bool]:
    """edges with each partition's replaced by stars, and whether that was all of them at once."""
    kept = ws.save(edges, "edges")
    parts = -(-kept.count() // TASK_EDGES)
    out = ws.save(kept.coalesce(max(1, parts)).mapInArrow(_contracted, "a long, b long"), "stars")
    ws.drop(kept)
    return out, parts <= 1


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none downwards: each component is then a star around its least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").head(1)
