"""Written files: listing, reading, writing under exact names, CSV."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import sink


def paths(chunked: bool, fmt: str, flat: bool = False) -> Column:
    """Relative path of a page's or chunk's file. Pages whose names clash get a part of their address's hash: see distinct_paths."""
    name = U.safe_name(F.col("title"), F.col("url"))
    number = F.col("chunk_index").cast("string")
    part = F.when(F.col("chunk_total") > 1, F.concat(F.lit(".chunk-"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), "0"))).otherwise("") if chunked else F.lit("")
    folder = F.lit("") if flat else F.concat(F.col("root"), F.lit("/"))
    return F.concat(folder, name, part, F.lit(T.extension(fmt)))


def _base(path: Column) -> Column:
    """A path without its chunk number: what a page's files have in common."""
    return F.regexp_replace(path, r"(\.chunk-\d+)?(\.[^.]*)$", "$2")


def distinct_paths(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """rows (url, path) with paths that several urls share made different. taken: url and path of files of earlier runs.

    The url that has a name from an earlier run keeps it, else the least url gets it; the others' names get a part of
    their address's hash, and the whole of it where that clashes as well.
    """
    held = None
    if taken is not None:
        held = taken.select(_base(F.col("path")).alias("_base"), F.col("url")).groupBy("_base").agg(F.min("url").alias("_holder"), F.collect_set("url").alias("_holders"))
    for digits in (8, 64):
        rows = rows.withColumn("_base", _base(F.col("path")))
        owner = rows.groupBy("_base").agg(F.min("url").alias("_owner"))
        if held is not None:
            # of several that held a name before, which no run of this kind leaves, none loses it
            owner = owner.join(held, "_base", "left").select("_base", F.coalesce("_holder", "_owner").alias("_owner"), "_holders")
        else:
            owner = owner.withColumn("_holders", F.lit(None).cast("array<string>"))
        mine = (F.col("url") == F.col("_owner")) | F.coalesce(F.array_contains("_holders", F.col("url")), F.lit(False))
        suffix = F.concat(F.lit("-"), F.left(F.sha2("url", 256), F.lit(digits)))
        own = F.concat(F.regexp_replace("path", r"(\.chunk-\d+)?\.[^.]*$", ""), suffix, F.regexp_extract("path", r"((\.chunk-\d+)?\.[^.]*)$", 1))
        rows = rows.join(owner, "_base").withColumn("path", F.when(mine, F.col("path")).otherwise(own)).drop("_base", "_owner", "_holders")
    return rows


def remove(rows: DataFrame, folder: str) -> None:
    """Deletes the files (path) below a folder that all executors share; those that are not there are no error."""

    def run(part: Iterator) -> None:
        system, base = sink.file_system(folder)
        for row in part:
            target = sink.below(base, row.path)
            if system.get_file_info(target).type == FileType.File:
                system.delete_file(target)

    rows.select("path").distinct().foreachPartition(run)


def write(rows: DataFrame, folder: str) -> None:
    """One file per row (path, payload) below a folder that all executors share: all of them or, if the job fails, none.
    Files replace older ones whole."""
    sink.register(rows.sparkSession)
    rows.select("path", F.col("payload").cast("binary")).write.format(sink.FORMAT).mode("append").save(folder)


def write_table(rows: DataFrame, folder: str) -> None:
    """The scalable form: path and payload as Parquet, by root folder."""
    rows.withColumn("root", F.substring_index("path", "/", 1)).write.mode("overwrite").partitionBy("root").parquet(folder)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (relative) of all files below a folder; contents are not read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select(_relative(base).alias("path"))


def read(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """path (relative) and content (UTF-8)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select(_relative(base).alias("path"), F.decode("content", "UTF-8").alias("content"))


def _relative(base: str) -> Column:
    """Schemes write local roots with one slash or three."""
    plain = F.regexp_replace("path", r"^([a-z0-9]+):/+", "$1:/")
    import re

    return F.url_decode(F.replace(F.substr(plain, F.lit(len(re.sub(r"^([a-z0-9]+):/+", r"\1:/", base)) + 2)), F.lit("+"), F.lit("%2B")))


def write_csv(rows: DataFrame, folder: str, append: bool = True, single: bool = False) -> None:
    """Rows of render.csv_rows() as CSV with a header. single: one part file, which one task writes."""
    rows = rows.coalesce(1) if single else rows
    rows.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return rows.fillna("")
