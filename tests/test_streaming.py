import datetime

from foliate.config import Config
from foliate.operators.state import Store
from foliate.sources import http
from foliate.streaming import ingest


def land(spark, tmp_path, rows, day):
    at = datetime.datetime(2026, 1, day)
    df = spark.createDataFrame([(u, h, at) for u, h in rows], ingest.SCHEMA)
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))


def run(spark, tmp_path):
    q = ingest.start(spark, *(str(tmp_path / n) for n in ("landing", "state", "out", "checkpoint")), Config(max_chunk_words=5, chunk_overlap_words=1), once=True)
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_new_changed_and_unchanged_pages(spark, tmp_path):
    land(spark, tmp_path, [("https://h/a", "<title>A</title><h2>x</h2><p>one two three four five six seven"), ("https://h/b", "<title>B</title>b")], 1)
    first = run(spark, tmp_path)
    assert sorted((r.url, r.chunk_index, r.chunk_total) for r in first.collect()) == [("https://h/a", 1, 2), ("https://h/a", 2, 2), ("https://h/b", 1, 1)]
    land(spark, tmp_path, [("https://h/a/", "<title>A</title><h2>x</h2><p>one two three four five six seven"), ("https://h/b", "<title>B</title>new"), ("https://h/c", None)], 2)
    second = run(spark, tmp_path).where("batch = 1")
    assert [(r.url, r.content) for r in second.collect()] == [("https://h/b", "new")]
    store = Store(spark, str(tmp_path / "state"))
    assert {r.url: r.updated_at[:10] for r in store.load().collect()} == {"https://h/a": "2026-01-01", "https://h/b": "2026-01-02"}
    # the same batch again, after its state was saved
    raw = spark.read.parquet(str(tmp_path / "landing")).where("fetched_at > '2026-01-01 12:00:00'")
    ingest.batch(raw, store, str(tmp_path / "out"), Config(max_chunk_words=5, chunk_overlap_words=1), 1)
    assert [(r.url, r.content) for r in spark.read.parquet(str(tmp_path / "out" / "batch=1")).collect()] == [("https://h/b", "new")]


def test_http_fetch_with_a_stand_in(spark):
    frontier = spark.createDataFrame([("https://h/a", 1), ("https://i/b", 2)], "url string, n int")
    fetched = http.fetch(frontier, Config(delay_seconds=0), lambda url, config: (200, url.upper(), None) if "a" in url else (None, None, "timeout"))
    got = {r.url: (r.n, r.status, r.html, r.error) for r in fetched.collect()}
    assert got == {"https://h/a": (1, 200, "HTTPS://H/A", None), "https://i/b": (2, None, None, "timeout")}
    assert http.get("http://127.0.0.1:9/", Config(request_timeout=1))[0] is None


def test_rest_is_asked_first_and_html_where_it_gives_no_body(spark):
    asked = {"https://h/rest/1?expand=body.view,children.page,title": '{"title": "One", "body": {"view": {"value": "<p>rest</p>"}}}'}

    def stand_in(url, config, accept=None):
        if accept is not None:
            return (200, asked.get(url, '{"body": null}'), None)
        return (200, f"<title>T</title><p>{url[-1]}</p>", None)

    frontier = spark.createDataFrame([("https://h/v?pageId=1",), ("https://h/v?pageId=2",), ("https://h/3",)], "url string")
    rows = {r.url[-1]: r for r in http.fetch(frontier, Config(delay_seconds=0, api_base="https://h/rest/"), stand_in).collect()}
    assert rows["1"].html is None and "rest" in rows["1"].api
    assert [rows[i].api for i in "23"] == [None, None] and all(i in rows[i].html for i in "23")
