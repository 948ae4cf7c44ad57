import random

import pytest
from foliate.llm import urls
from foliate.llm.workspace import Workspace
from pyspark.sql import functions as F

URLS = [
    None,
    "",
    "no scheme/at all",
    "http://WWW.Example.ORG/es/x?q#f",
    "https://example.org/en/17",
    "https://example.org/en/2",
    "https://notexample.org/es/x",
    "x://a.example.com/fr/1",
    "x://a.example.com/de/1#/fr/",
    "x://a.example.com?p=/de/",
    "x://example.net/a://b/c",
    "x://m.ads-track.example.com/en/1",
    "x://ads-track.example.com",
    "x://bads-track.example.com/x",
    "x://ads-track.example.com/fr/1",
    "http://É.example.net/ü",
    "://cheap-pills.example.net",
    "a\n://org/\nx",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(t), t, w) for w, t in urls.RULES if (host == (h := t.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + t.split("/", 1)[1])]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    listed = any(host == x or host.endswith("." + x) for x in urls.LISTED)
    return host, path, None, "block" if listed else "allow"


@pytest.mark.parametrize("most_bits", [urls.MOST_BITS, 64])
def test_equals_a_plain_judgement_in_one_shard_and_in_many(spark, most_bits):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], None), (None, URLS[4], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([(x,) for x in urls.LISTED] + [(None,)], "key string")
    out = urls.judge(df, listed, most_bits=most_bits).collect()
    assert sorted((r.page_id is None, r.page_id, *r[1:4]) for r in out if r[3]) == sorted((i is None, i, *plain(u)[:3]) for i, u, _ in rows if plain(u)[2])
    assert sorted(map(repr, [tuple(r) for r in out])) == sorted(repr((i, *plain(u))) for i, u, _ in rows)
    assert urls.judge(df.where("false"), listed).count() == 0
    assert {r.verdict for r in urls.judge(df, listed.where("false")).where("rule is null").collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(2)
    keys = [(f"host{i}.example", rng.random() < 0.03) for i in range(4000)]
    df = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = urls.build(Workspace(spark, "test"), df)
    assert len(cascade.levels) > 1
    got = df.select("listed", cascade.member(F.col("key")).alias("said"))
    assert got.where("listed <> said").count() == 0
    assert sum(x.bits for x in cascade.levels) < 16 * sum(x for _, x in keys)


def test_the_plan_has_no_join_and_no_python(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    plan = urls.judge(df, spark.createDataFrame([(x,) for x in urls.LISTED], "key string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
