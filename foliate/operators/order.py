"""Places of rows in one order over the whole table, without one task that sees all of them; and groups in order, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import storage


def ranked(rows: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """rows with their place (bigint, from 0) in the order of the columns by.

    Rows are dealt by ranges of by and sorted in each; their numbers by range, a row for each range, give where a range
    begins. Rows with equal by share a range, so by should hardly repeat. The table is written once in between.
    """
    place = "_place"  # the range in the upper 31 bits, the row in the lower 33
    sorted_ = storage.save(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id()), "ranked")
    low = F.lit((1 << 33) - 1)
    part = F.shiftright(place, 33).cast("int")
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = storage.save(counts.select("_part", F.coalesce(start, F.lit(0)).alias("_start")), "starts")
    return sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col(place).bitwiseAND(low)).cast("bigint")).drop("_part", "_start", place)


def streamed(rows: DataFrame, by: list[str], order: list[str], step: Callable[[Iterator[dict]], Iterator[dict]], schema: StructType) -> DataFrame:
    """by and the columns of schema: what step makes of each group's other columns, which come row by row in this order.

    A group goes to one task, which holds a batch of it and what step holds; Spark sorts on disk. Values of schema, strings,
    bytes and whole numbers (bigint), must not be null.
    """
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    rest, names = [c for c in rows.columns if c not in keys], schema.names

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        for batch in batches:
            own = batch.select(keys)
            for i, row in enumerate(batch.select(rest).to_pylist()):
                yield own.slice(i, 1), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(flat(batches), lambda x: x[0].to_pylist()):
            own, first = next(group)
            for made in step(r for part in ([first], (row for _, row in group)) for r in part):
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([made[n]]) for n in names)], names=[*keys, *names])

    out = StructType([*(rows.schema[c] for c in keys), *schema.fields])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out).select(*by, *names)
