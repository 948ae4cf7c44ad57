"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from foliate.storage import shared_dir
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to Python.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get by bytes, so that long texts do not fill their memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH:
        spark.conf.set(key, str(BATCH))


class Workspace:
    """Tables written below one folder of their own; drop() and only() delete those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back: cuts lineage and survives lost executors."""
        path = self.path(name)
        df.write.parquet(path)
        self._paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._foliate_path = path
        return out

    def named_as(self, table: DataFrame, view: DataFrame) -> DataFrame:
        """view, which reads the saved table, as a name for it in drop() and only()."""
        view._foliate_path = table._foliate_path
        return view

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(getattr(table, "_foliate_path", None))

    def only(self, *tables: DataFrame) -> None:
        """Deletes every saved table but these."""
        for path in self._paths - {getattr(t, "_foliate_path", None) for t in tables}:
            self._delete(path)

    def _delete(self, path: str | None) -> None:
        if path in self._paths:
            self._paths.discard(path)
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
