"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where it is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="foliate-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes and rows of an Arrow batch where what comes back is many times what goes to Python.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, for columns that are worked out later."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([kmgtp]?)b?\s*", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


#: For save(), where rows are large: Spark reads up to 4,096 rows of a row group at once.
SMALL_GROUPS = {"parquet.block.size": 8 << 20}


def save(df: DataFrame, name: str, **options: int) -> DataFrame:
    """df written as Parquet, with the writer's options, and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A save(df, name) whose tables are deleted at the end."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    try:
        yield put
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder, bucketed and sorted by key, which joins by key do not shuffle; and what deletes it.

    It has as many buckets as a shuffle has partitions, and an entry of its own in the session's catalog meanwhile.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by key first, so that a bucket is one file
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.table(table), drop
