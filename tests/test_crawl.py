from foliate.config import Config
from foliate.operators import crawl
from foliate.sources import pages as P
from foliate.sources import seeds


def graph(spark, edges, titles=None):
    urls = sorted({u for e in edges for u in e})
    rows = [(u, (titles or {}).get(u, u.upper()), [b for a, b in edges if a == u] or None) for u in urls]
    return spark.createDataFrame(rows, "url string, title string, children array<string>")


def run(spark, edges, roots=("a",), depth=9, titles=None):
    seed = spark.createDataFrame([(u, f"r{i}", i) for i, u in enumerate(roots)], "url string, root string, root_order bigint")
    out = crawl.crawl(seed, crawl.from_store(graph(spark, edges, titles)), depth).collect()
    assert len({r.url for r in out}) == len(out)
    return {r.url: (r.depth, r.parent_url, r.root, list(r.breadcrumb)) for r in out}


def test_cycle_diamond_and_self_loop(spark):
    got = run(spark, [("a", "a"), ("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")])
    assert got["d"] == (3, "b", "r0", ["A", "B"]) and got["e"] == (4, "d", "r0", ["A", "B", "D"]) and got["a"] == (1, None, "r0", [])


def test_depth_roots_and_untitled_ancestors(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("z", "c")]
    assert set(run(spark, edges, depth=2)) == {"a", "b"} and set(run(spark, edges, depth=1)) == {"a"}
    got = run(spark, edges, roots=("z", "a"), titles={"b": ""})
    assert got["c"] == (2, "z", "r0", ["Z"]) and got["b"][2] == "r1"
    assert run(spark, edges, titles={"b": ""})["c"][3] == ["A"]


def test_missing_pages_and_no_seeds(spark):
    got = run(spark, [("a", "b")], roots=("gone", "a"))
    assert got["gone"][0] == 1 and "b" in got
    assert run(spark, [("a", "b")], roots=()) == {}


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.md").write_text("# comment\n\n  https://B.example.com/x/ \nhttps://a.example.com/y\nhttps://b.example.com/x\r\n  # last\n")
    lines = seeds.lines(spark, str(tmp_path / "seeds.md"))
    assert seeds.scope(lines) == (["b.example.com", "a.example.com"], "b.example.com")
    got = seeds.roots(lines, *seeds.scope(lines)).orderBy("root_order").collect()
    assert [(r.url, r.root) for r in got] == [("https://b.example.com/x", "x"), ("https://b.example.com/y", "y")]


def test_page_store_takes_the_rest_answer_first(spark):
    api = '{"title": "Api", "body": {"view": {"value": "<p>from api</p>"}}, "children": {"page": {"results": [{"id": 7}, {"id": "8"}, {}]}}}'
    rows = [
        ("https://h/pages/viewpage.action?pageId=1", "<title>H</title><p>x", api, 200),
        ("https://h/display/a", "<title>Page - Site</title><p>b <a href='/display/c#f'>c</a><a href='../display/c'>c</a>", '{"body": {}}', 200),
        ("https://h/display/gone", "<p>x", None, 404),
        ("https://h/display/bad", "<title>t</title>ok", "no json", 200),
    ]
    df = spark.createDataFrame(rows, "url string, html string, api string, status int")
    got = {r.url.rsplit("/", 1)[1]: r for r in P.store(df, Config(site_names="Site"), ["h"], "h").collect()}
    one = got["viewpage.action?pageId=1"]
    assert (one.title, one.markdown, one.children) == ("Api", "from api", ["https://h/pages/viewpage.action?pageId=7", "https://h/pages/viewpage.action?pageId=8"])
    assert (got["a"].title, got["a"].children) == ("Page", ["https://h/display/c"])
    assert got["gone"].markdown is None and got["bad"].markdown == "ok"
