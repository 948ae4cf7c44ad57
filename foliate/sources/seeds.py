"""Seed lists: text lines with comments and blanks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U


def lines(spark: SparkSession, path: str) -> DataFrame:
    """ord and line of a seed file; the file is one split, so ord follows the lines."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("ord", "line")).select(F.col("ord").cast("bigint"), "line")


def entries(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments, stripped."""
    rows = lines.select("ord", T.strip(F.col("line")).alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def roots(lines: DataFrame, allowed: Sequence[str] = (), preferred: str | None = None) -> DataFrame:
    """url, root (folder), root_order: canonical seeds, each at its first place."""
    rows = entries(lines).select("ord", U.canonical(F.col("line"), allowed, preferred).alias("url"))
    rows = rows.where("url <> ''").groupBy("url").agg(F.min("ord").alias("root_order"))
    return rows.select("url", U.root_name(F.col("url")).alias("root"), "root_order")


def domains(lines: DataFrame) -> DataFrame:
    """host and its first place; the least is the preferred one."""
    rows = entries(lines).select("ord", U.host(F.col("line")).alias("host"))
    return rows.where("host <> ''").groupBy("host").agg(F.min("ord").alias("ord"))


def scope(lines: DataFrame) -> tuple[list[str], str]:
    """Allowed hosts in order and the preferred one; seeds are a hand-written list, so this is small."""
    hosts = [r.host for r in domains(lines).orderBy("ord").collect()]
    return hosts, hosts[0] if hosts else ""


def from_urls(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    """ord and line of addresses given directly."""
    return spark.createDataFrame(list(enumerate(urls)), "ord bigint, line string")
