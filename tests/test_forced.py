"""What forced and incremental runs delete, and what failed fetches leave; long runs of blanks and many child lists."""

import glob
import logging
import os
import time

from foliate import cli
from foliate.functions import text as T
from foliate.operators import crawl, html
from foliate.operators.state import Store
from foliate.sources import files, pages
from pyspark.sql import functions as F

H = "https://h.example.com/display/"
ROOT = "<title>Root</title><p>start <a href='/display/one'>1</a> <a href='/display/two'>2</a></p>"
SITE = {"root": (ROOT, 200, None), "one": ("<title>One</title><p>first</p><a href='/display/deep'>d</a>", 200, None), "two": ("<title>Two</title><p>second</p>", 200, None), "deep": ("<title>Deep</title><p>third</p>", 200, None)}


def run(spark, tmp_path, site, *extra):
    store = str(tmp_path / "pages.parquet")
    rows = [(H + k, *v) for k, v in site.items()]
    spark.createDataFrame(rows, "url string, html string, status int, error string").write.mode("overwrite").parquet(store)
    (tmp_path / "seeds.md").write_text(H + "root\n")
    out = str(tmp_path / "out")
    assert cli.main(["--pages", store, "--docs-file", str(tmp_path / "seeds.md"), "--out", out, *extra], spark) == 0
    return sorted(os.path.relpath(p, out) for p in glob.glob(f"{out}/root/*")), {r.url.removeprefix(H) for r in Store(spark, f"{out}/.state").load().collect()}


ALL = ["root/deep.md", "root/one.md", "root/root.md", "root/two.md"]


def test_forced_runs_delete_only_what_is_gone(spark, tmp_path, caplog):
    assert run(spark, tmp_path, SITE) == (ALL, set(SITE))
    down = (None, None, "URLError: timed out")
    # the root does not answer: nothing goes, and the log and the index say why
    with caplog.at_level(logging.WARNING, "foliate"):
        assert run(spark, tmp_path, SITE | {"root": down}, "--force") == (ALL, set(SITE))
    assert "1 pages failed with URLError: timed out, such as https://h.example.com/display/root" in caplog.text
    assert "Errors: **1**" in open(tmp_path / "out/_index.md").read()
    # a root that is missing from the store is no reason either, nor is an empty store
    assert run(spark, tmp_path, {k: v for k, v in SITE.items() if k != "root"}, "--force") == (ALL, set(SITE))
    # a child at 503 stays, and so does what only it leads to
    assert run(spark, tmp_path, SITE | {"one": (None, 503, None)}, "--force") == (ALL, set(SITE))
    assert "Errors: **1**" in open(tmp_path / "out/_index.md").read()
    # an empty page is no page that is gone, one that no link leads to is not either
    assert run(spark, tmp_path, SITE | {"two": ("", 200, None), "one": ("<title>One</title><p>no link</p>", 200, None)}, "--force") == (ALL, set(SITE))
    # 404, and one that the store does not have
    left = {k: v for k, v in SITE.items() if k != "deep"} | {"two": ("<p>not found</p>", 404, None)}
    assert run(spark, tmp_path, left, "--force") == (["root/one.md", "root/root.md"], {"root", "one"})
    assert "Skipped: **2**  |  Errors: **0**" in open(tmp_path / "out/_index.md").read()


def test_forced_csv_keeps_the_rows_of_failed_pages(spark, tmp_path):
    titles = lambda: sorted(r.title for r in files.read_csv(spark, str(tmp_path / "out/_pages.csv")).collect())
    run(spark, tmp_path, SITE, "--format", "csv")
    assert titles() == ["Deep", "One", "Root", "Two"]
    run(spark, tmp_path, SITE | {"one": (None, None, "timeout"), "two": (None, 410, None)}, "--format", "csv", "--force")
    assert titles() == ["Deep", "One", "Root"]


def test_fewer_chunks_leave_no_old_files(spark, tmp_path):
    words = ["--chunk", "--max-words", "20", "--overlap-words", "2"]
    long = lambda n: ("<title>Two</title>" + "".join(f"<h2>Part {i}</h2><p>{'word ' * 15}</p>" for i in range(n)), 200, None)
    got, _ = run(spark, tmp_path, SITE | {"two": long(4)}, *words)
    assert [p for p in got if "two" in p] == [f"root/two.chunk-0{i}.md" for i in (1, 2, 3, 4)]
    got, _ = run(spark, tmp_path, SITE | {"two": long(2)}, *words)
    assert [p for p in got if "two" in p] == [f"root/two.chunk-0{i}.md" for i in (1, 2)]
    # another format beside it deletes nothing
    got, _ = run(spark, tmp_path, SITE | {"two": long(2)}, *words, "--format", "txt")
    assert [p for p in got if "two" in p] == [f"root/two.chunk-0{i}.{x}" for i in (1, 2) for x in ("md", "txt")]


def test_store_tells_failures_from_empty_pages(spark):
    raw = spark.createDataFrame(
        [("https://h/a", "<p>x</p>", 200, None), ("https://h/b", "", 200, None), ("https://h/c", "x", 503, None), ("https://h/d", None, 404, None), ("https://h/e", None, None, "timeout")],
        "url string, html string, status int, error string",
    )
    rows = pages.store(raw).withColumn("s", crawl.status())
    assert {r.url[-1]: (r.s, r.error, r.http_status) for r in rows.collect()} == {
        "a": ("ok", None, 200), "b": ("skipped", None, 200), "c": ("error", "HTTP 503", 503), "d": ("skipped", None, 404), "e": ("error", "timeout", None),
    }


def test_of_equal_raw_urls_the_least_page_id_counts(spark):
    rows = [(f"{H}p{k}", "<title>T</title><p>x</p>", 200 + v, n) for k in range(20) for v, n in ((303, 2), (0, 1), (204, 3))]
    for order in (F.col("page_id"), F.col("page_id").desc(), F.hash("page_id", "url")):
        raw = spark.createDataFrame(rows, "url string, html string, status int, page_id bigint").repartition(5).sortWithinPartitions(order)
        assert {r.http_status for r in pages.store(raw).collect()} == {200}
        # without one, runs agree whatever the order of rows
        assert len({r.http_status for r in pages.store(raw.drop("page_id")).collect()}) == 1


def test_blanks_take_time_in_proportion(spark):
    n = 1_000_000
    rows = spark.createDataFrame([(1, "a" + " " * n + "b" + "\t " * (n // 2) + "\nc \x0b\n", "t" + " " * n + "- ")], "id int, text string, title string")
    rows.select(T.strip(F.col("text"))).collect()
    began = time.time()
    got = rows.select(T.strip(F.col("text")).alias("s"), T.clean_noise(F.col("text")).alias("n"), T.title_without_site(F.col("title")).alias("t")).first()
    assert time.time() - began < 5
    assert len(got.s) == 2 * n + 4 and got.n == "a" + " " * n + "b\nc" and got.t == "t"


def test_many_child_lists_take_time_in_proportion():
    def slow(root):
        out = []
        for string, parent in root.strings():
            if "child pages" in string.lower():
                box = parent
                while box is not None and box.tag not in ("ul", "div", "section"):
                    box = box.parent
                if box is not None:
                    out += [n.attrs["href"] for n in box.walk() if n.tag == "a" and n.attrs.get("href")]
        return list(dict.fromkeys(out))

    nested = "<div><a href=mailto:0></a><section><p>Child pages<b>child pages</b></p><a href=mailto:1></a><ul><li>child pages<a href=mailto:2></a></ul></section><span>child pages</span><a href=mailto:3></a></div>child pages<a href=mailto:4></a>"
    for page in (nested, nested * 3, f"<section>child pages{nested}</section>"):
        assert html.links(html.parse(page)) == slow(html.parse(page))
    wide = "<div>" + "<p>child pages <a href='/x'>x</a></p>" * 10_000 + "</div>"
    root = html.parse(wide)
    began = time.time()
    assert html.links(root) == ["/x"]
    assert time.time() - began < 1
