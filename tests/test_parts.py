"""Documents and indexes in parts, and places in an order that no task sees whole."""

import os

import pytest
from foliate import cli
from foliate.operators import consolidate, crawl
from foliate.operators.order import ranked
from pyspark.sql import functions as F

from tests.test_forced import ALL, SITE, run


def joined(parts):
    rows = sorted(parts.collect(), key=lambda r: r.part)
    assert [r.part for r in rows] == list(range(len(rows)))
    return "".join(r.content for r in rows), [r.n for r in rows]


def pages(spark, n):
    i = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("f"), (F.col("id") % 3).cast("string"), F.lit("/"), F.lpad(i, 5, "0"), F.lit(".md")).alias("path"), F.concat(F.lit("T <"), i).alias("title"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("u"), i)).alias("url"),
        F.lit("now").alias("scraped_at"), F.array().cast("array<string>").alias("breadcrumb"), F.concat(F.lit(" body {i} "), i).alias("body"),
    )


@pytest.mark.parametrize("n,per_part", [(25, 7), (21, 7), (1, 7), (3, 1)])
def test_parts_one_behind_another_are_the_whole(spark, n, per_part):
    rows = pages(spark, n).repartition(3)
    for parts, whole in ((consolidate.md_parts, consolidate.md), (consolidate.txt_parts, consolidate.txt), (consolidate.html_parts, consolidate.html)):
        text, sizes = joined(parts(rows, per_part))
        assert text == whole(rows).first().content and max(sizes) <= per_part
    stats = crawl.stats(rows.select(F.lit("new").alias("status")))
    text, sizes = joined(consolidate.index_parts(rows.select("path"), stats, per_part))
    assert text == consolidate.index(rows.select("path"), stats).first().content and sum(sizes) == n


def test_no_pages_no_parts(spark):
    assert consolidate.md_parts(pages(spark, 0)).count() == consolidate.html_parts(pages(spark, 0)).count() == 0


def test_ranked(spark):
    rows = spark.createDataFrame([(i * 7919 % 100, "x") for i in range(100)] + [(None, "y"), (5, "z")], "a int, rank string").repartition(6)
    got = ranked(rows, "a", name="place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(102)) and [r.a for r in got] == [None, *sorted([*range(100), 5])]
    plan = ranked(rows, "a", name="place")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan  # but for the table of ranges, which is written before


def test_a_large_index_is_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "INDEX_FILES", 2)
    assert run(spark, tmp_path, SITE, "--consolidate") == (ALL, set(SITE))
    assert sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("_index")) == ["_index.part-00000.md"]
    assert cli.main(["--consolidate-only", "--out", str(tmp_path / "out")], spark) == 0
    assert "*4 pages merged.*" in open(tmp_path / "out/_all.md").read()
