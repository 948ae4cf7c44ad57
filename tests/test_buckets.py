"""Levels of a crawl over a bucketed store."""

import re

from foliate import storage
from foliate.operators import crawl
from pyspark.sql import functions as F


def test_a_level_does_not_shuffle_the_store(spark):
    pages = spark.range(1000).select(F.format_string("p%04d", "id").alias("url"), F.lit("t").alias("title"), F.array(F.format_string("p%04d", F.col("id") + 1)).alias("children"))
    store, drop = storage.bucketed(pages, "pages", "url")
    name = re.search(r"pages_[0-9a-f]{32}", str(store._jdf.queryExecution().analyzed().toString()))[0]
    try:
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frontier = spark.createDataFrame([("p0001", 1), ("gone", 2)], "url string, depth int")
        level = crawl.from_store(store)(frontier)
        plan = level._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # that of the frontier
        assert {r.url: r.children for r in level.collect()} == {"p0001": ["p0002"], "gone": None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        drop()
    assert not spark.catalog.tableExists(name)


def test_other_columns_come_back_once(spark):
    pages = spark.createDataFrame([("a", "A", ["b", "c"], "body a"), ("b", "B", None, "body b")], "url string, title string, children array<string>, markdown string")
    seeds = spark.createDataFrame([("a", "r", 0)], "url string, root string, root_order bigint")
    got = {r.url: (r.depth, r.parent_url, list(r.breadcrumb), r.markdown) for r in crawl.crawl_store(seeds, pages, 3).collect()}
    assert got == {"a": (1, None, [], "body a"), "b": (2, "a", ["A"], "body b"), "c": (2, "a", ["A"], None)}
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("pages_")] == []
    assert crawl.crawl_store(seeds.limit(0), pages, 3).count() == 0
