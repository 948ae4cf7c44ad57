import csv
import glob
import os
import re
import zlib

from foliate import cli
from foliate.functions import text as T
from foliate.operators import consolidate, crawl, pdf, render
from foliate.sources import files
from pyspark.sql import functions as F

PAGES = [
    ("a/alpha.md", "Alpha Page", "https://e.com/alpha", "2026-04-17T00:00:00Z", ["Root"], "## One\n\nAlpha **bold**\n\n## Two\n\ntext"),
    ("b/beta.md", 'Beta "x" <&>', "https://e.com/beta", "2026-04-17T00:01:00Z", ["Root", "Alpha Page"], "## Three\n\nBeta body"),
    ("b/bare.md", None, None, None, None, None),
]
SCHEMA = "path string, title string, url string, scraped_at string, breadcrumb array<string>, body string"


def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


def test_render(spark):
    got = {r.path: r for r in pages(spark).select("path", render.md().alias("md"), render.txt().alias("txt"), render.html().alias("html"), render.pdf_bytes().alias("pdf")).collect()}
    a, b, bare = (got[p[0]] for p in PAGES)
    assert a.md.startswith('---\ntitle: "Alpha Page"\nsource_url: "https://e.com/alpha"\nscraped_at: "2026-04-17T00:00:00Z"\nbreadcrumb: ["Root"]\n---\n\n## One')
    assert a.txt.startswith("Alpha Page\n==========\n\nSection: Root\n\nSource: https://e.com/alpha\n\nScraped: 2026-04-17T00:00:00Z\n\n\nOne") and "**" not in a.txt
    assert "<title>Beta &quot;x&quot; &lt;&amp;&gt;</title>" in b.html and "Root &rsaquo; Alpha Page" in b.html and "<strong>bold</strong>" in a.html
    assert bytes(a.pdf).startswith(b"%PDF") and bytes(a.pdf).rstrip().endswith(b"%%EOF")
    assert bare.md.endswith("---\n\n") and bare.txt == "\n" and "<title></title>" in bare.html


def test_written_markdown_parses_back(spark):
    rows = pages(spark).select("path", render.md().alias("content"))
    got = {r.path: r for r in render.parse(rows).collect()}
    assert (got["a/alpha.md"].title, got["a/alpha.md"].body, list(got["b/beta.md"].breadcrumb)) == ("Alpha Page", PAGES[0][5], ["Root", "Alpha Page"])
    assert render.parse(spark.createDataFrame([("x/some-file.md", "no header")], "path string, content string")).first().title == "some-file"


def test_consolidate(spark):
    md = consolidate.md(pages(spark)).first()
    assert md.n == 3 and "*3 pages merged.*" in md.content and md.content.index("## Alpha Page") < md.content.index('## Beta "x"') and "> **Source:** [https://e.com/beta]" in md.content
    txt = consolidate.txt(pages(spark)).first().content
    assert "=" * 80 + "\nAlpha Page\n" + "=" * 80 in txt and "Alpha bold" in txt
    html = consolidate.html(pages(spark)).first().content
    assert html.startswith("<!DOCTYPE html>") and "Contents (3 pages)" in html and all(f'href="#page-{i}"' in html and f'id="page-{i}"' in html for i in (1, 2, 3))
    out = bytes(consolidate.pdf_document(pages(spark)).first().content)
    assert len(out) > 1024 and out.startswith(b"%PDF") and b"/Count 3" in out
    assert consolidate.consolidate(pages(spark), "csv") is None
    assert consolidate.consolidate(pages(spark).where("false"), "md").count() == 0
    assert {r.path.split("/")[0]: r.n for r in consolidate.md(pages(spark).withColumn("g", F.substring_index("path", "/", 1)), ["g"]).withColumnRenamed("g", "path").collect()} == {"a": 1, "b": 2}


def test_candidates_and_companions(spark):
    names = ["x/_index.md", "_all.md", "p.md", "q.chunk-01.md", "r.txt", "s.json", "md", ".md"]
    got = consolidate.candidates(spark.createDataFrame([(n,) for n in names], "path string"), ".md")
    assert {r.path for r in got.collect()} == {"p.md", "q.chunk-01.md"}
    pdfs = spark.createDataFrame([("d/a.pdf",), ("d/b.pdf",)], "path string")
    texts = spark.createDataFrame([("d/a.md", "hello"), ("e/b.md", "other")], "path string, content string")
    assert {r.path: r.content for r in consolidate.companions(pdfs, texts).collect()} == {"d/a.pdf": "hello", "d/b.pdf": '---\ntitle: "b"\n---\n'}


def test_index(spark):
    stats = crawl.stats(spark.createDataFrame([("new",), ("changed",), ("unchanged",), ("error",)], "status string"))
    paths = spark.createDataFrame([("b/x-y.md",), ("a/k.chunk-02.md",), ("b/a.md",), ("top.md",)], "path string")
    got = consolidate.index(paths, stats).first().content
    assert got.endswith("\n## a\n\n- [K Chunk 02](a/k.chunk-02.md)\n\n## b\n\n- [A](b/a.md)\n- [X Y](b/x-y.md)\n- [Top](top.md)")
    assert "Pages written: **2**  |  Unchanged: **1**  |  Skipped: **0**  |  Errors: **1**" in got


def test_pdf_text_and_page_breaks():
    out = pdf.document([pdf.page("Tïtle (x)", "u", "", ["a"], "word " * 3000 + "\n\n" + "y" * 500 + "\n\n東京")])
    text = b"".join(zlib.decompress(p) for p in re.findall(rb"(?s)>>\nstream\n(.*?)\nendstream", out))
    assert text.count(b"word") == 3000 and b"T\xeftle \\(x\\)" in text and b"??" in text and text.count(b"y") >= 500
    assert int(out.split(b"/Count ")[1].split()[0]) > 3
    at = int(out.rsplit(b"startxref\n", 1)[1].split()[0])
    assert out[at : at + 4] == b"xref"


def test_csv_round_trip(spark, tmp_path):
    rows = render.csv_rows(pages(spark))
    files.write_csv(rows, str(tmp_path / "c"), append=False, single=True)
    (name,) = glob.glob(str(tmp_path / "c" / "*.csv"))
    with open(name, newline="", encoding="utf-8") as f:
        plain = list(csv.DictReader(f))
    assert [tuple(r) for r in plain][0] == render.CSV_FIELDS and len(plain) == 3
    assert sorted(tuple(r.values()) for r in plain) == sorted(tuple(r) for r in rows.collect()) == sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c")).collect())


def test_distinct_paths(spark):
    rows = spark.createDataFrame([("u1", "a.md"), ("u2", "a.md"), ("u3", "b.chunk-01.md"), ("u4", "b.chunk-01.md")], "url string, path string")
    got = {r.url: r.path for r in files.distinct_paths(rows).collect()}
    assert got["u1"] == "a.md" and got["u2"].startswith("a-") and got["u4"].endswith(".chunk-01.md") and len(set(got.values())) == 4


SITE = {
    "https://h.example.com/display/root": "<title>Root</title><body><p>start <a href='/display/one'>1</a> <a href='/display/two'>2</a> <a href='https://other.example.com/display/x'>o</a><a href='/login'>l</a>",
    "https://h.example.com/display/one": "<title>One</title><body><h2>Part</h2><p>" + "word " * 30 + "</p><h2>Other</h2><p>" + "more " * 30 + "</p>",
    "https://h.example.com/display/two": "<title>One</title><body><p>same title <a href='/display/root'>up</a><a href='/display/gone'>g</a>",
}


def crawl_site(spark, tmp_path, *extra, site=SITE):
    store = str(tmp_path / "pages.parquet")
    spark.createDataFrame(list(site.items()), "url string, html string").write.mode("overwrite").parquet(store)
    (tmp_path / "seeds.md").write_text("# roots\nhttps://h.example.com/display/root\n")
    out = str(tmp_path / "out")
    assert cli.main(["--pages", store, "--docs-file", str(tmp_path / "seeds.md"), "--out", out, *extra], spark) == 0
    return out, sorted(os.path.relpath(p, out) for p in glob.glob(f"{out}/**/*", recursive=True) if os.path.isfile(p) and not p.endswith(".log"))


def test_cli_end_to_end(spark, tmp_path):
    out, got = crawl_site(spark, tmp_path, "--chunk", "--max-words", "40", "--overlap-words", "5", "--consolidate")
    pages_ = [p for p in got if p.startswith("root/")]
    assert len(pages_) == 4 and "root/root.md" in pages_ and "root/one.chunk-01.md" in pages_ and "_index.md" in got and "_all.md" in got
    text = open(f"{out}/root/one.chunk-02.md").read()
    assert 'breadcrumb: ["Root"]' in text and 'chunk: "2/2"\nsection: "Other"' in text
    index = open(f"{out}/_index.md").read()
    assert "Pages written: **3**  |  Unchanged: **0**  |  Skipped: **1**" in index and index.count("- [") == 4
    before = {p: os.stat(f"{out}/{p}").st_mtime_ns for p in pages_}
    crawl_site(spark, tmp_path, "--chunk", "--max-words", "40", "--overlap-words", "5")
    assert before == {p: os.stat(f"{out}/{p}").st_mtime_ns for p in pages_}
    index = open(f"{out}/_index.md").read()
    assert "Pages written: **0**  |  Unchanged: **3**" in index and index.count("- [") == 4
    changed = SITE | {"https://h.example.com/display/two": "<title>Two</title>new"}
    crawl_site(spark, tmp_path, "--chunk", "--max-words", "40", "--overlap-words", "5", site=changed)
    assert "Pages written: **1**  |  Unchanged: **2**" in open(f"{out}/_index.md").read()


def test_pages_with_one_title_keep_their_files_over_runs(spark, tmp_path):
    one, two = "https://h.example.com/display/one", "https://h.example.com/display/two"
    start = {
        "https://h.example.com/display/root": "<title>Root</title><a href='/display/one'>1</a><a href='/display/two'>2</a>",
        one: "<title>Same</title>first",
        two: "<title>Same</title>second",
    }
    out, got = crawl_site(spark, tmp_path, site=start)
    names = [p for p in got if p.startswith("root/same")]
    at = {u: next(p for p in names if u in open(f"{out}/{p}").read()) for u in (one, two)}
    assert len(names) == 2 and at[one] == "root/same.md"
    for url in (two, one):  # either one changes alone
        start = start | {url: f"<title>Same</title>{'anew ' * 3}{url[-3:]}"}
        _, now = crawl_site(spark, tmp_path, site=start)
        assert now == got
        for u in (one, two):
            text = open(f"{out}/{at[u]}").read()
            assert u in text and start[u].split(">")[-1].strip() in text
    # a forced run leaves nothing of pages that have vanished
    del start[two]
    _, now = crawl_site(spark, tmp_path, "--force", site=start)
    assert sorted(set(got) - set(now)) == [at[two]]


def test_cli_formats(spark, tmp_path):
    for fmt in ("txt", "html", "pdf"):
        out, got = crawl_site(spark, tmp_path, "--format", fmt, "--flat", "--consolidate")
        assert f"root.{fmt}" in got and f"_all.{fmt}" in got
    assert open(f"{out}/_all.pdf", "rb").read(4) == b"%PDF"
    out, got = crawl_site(spark, tmp_path, "--format", "csv")
    rows = files.read_csv(spark, f"{out}/_pages.csv")
    assert rows.count() == 3
    crawl_site(spark, tmp_path, "--format", "csv", site=SITE | {"https://h.example.com/display/two": "<title>Two</title>new"})
    assert sorted(r.title for r in files.read_csv(spark, f"{out}/_pages.csv").collect()) == ["One", "Root", "Two"]


def test_consolidate_only_and_exit_codes(spark, tmp_path):
    out, _ = crawl_site(spark, tmp_path)
    (tmp_path / "out" / "root" / "own file.md").write_text("# by hand")
    assert cli.main(["--consolidate-only", "--out", out], spark) == 0
    text = open(f"{out}/_all.md").read()
    assert "## own file" in text and "## Root" in text and "*4 pages merged.*" in text and "Documentation Index" not in text
    assert cli.together(spark, str(tmp_path / "out"), "csv") is None
    (tmp_path / "none").mkdir()
    assert cli.together(spark, str(tmp_path / "none"), "md") is None
    assert cli.main(["--out", str(tmp_path / "none")], spark) == 1
    (tmp_path / "empty.md").write_text("# nothing\n")
    assert cli.main(["--out", str(tmp_path / "none"), "--docs-file", str(tmp_path / "empty.md")], spark) == 1
    assert T.extension("html") == ".html"
