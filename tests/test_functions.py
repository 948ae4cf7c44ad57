from foliate.config import Config
from foliate.functions import text as T
from foliate.functions import urls as U
from pyspark.sql import functions as F
import pytest


def values(spark, rows, *columns):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [tuple(r) for r in df.select(*(c(*map(F.col, names)).alias(f"o{i}") for i, c in enumerate(columns))).collect()]


def one(spark, value, function):
    return values(spark, [(value,)], function)[0][0]


CANONICAL = [
    ("  http://Docs.Example.com/a/b//#frag ", "https://docs.example.com/a/b"),
    ("docs.example.com/x?y=1", "https://docs.example.com/x?y=1"),
    ("docs.example.com:8080/p", "https://docs.example.com/p"),
    ("https://user:pw@Docs.example.com:443/p;v=1?q#f", "https://docs.example.com/p?q"),
    ("https://alias.example.com/pages/viewpage.action?x=1&pageId=77&y=2", "https://docs.example.com/pages/viewpage.action?pageId=77"),
    ("https://docs.example.com/pages/releaseview.action?pageid=77", "https://docs.example.com/pages/releaseview.action"),
    ("https://other.example.com/", "https://other.example.com"),
    ("//docs.example.com/z", "https://docs.example.com/z"),
    ("mailto:a@b.c", "https:a@b.c"),
]


def test_canonical(spark):
    allowed = ["docs.example.com", "alias.example.com"]
    got = values(spark, [(u,) for u, _ in CANONICAL], lambda u: U.canonical(u, allowed))
    assert [g[0] for g in got] == [w for _, w in CANONICAL]
    again = values(spark, [(w,) for _, w in CANONICAL if w.startswith("https://")], lambda u: U.canonical(u, allowed))
    assert [g[0] for g in again] == [w for _, w in CANONICAL if w.startswith("https://")]


def test_page_id_scope_and_schemes(spark):
    c = Config()
    rows = [("https://h/pages/viewpage.action?PAGEID=12",), ("https://h/display/A",), ("https://h/display",), ("https://h/rest/display/",), ("https://h/displays/A",), ("javascript:x",)]
    got = values(spark, rows, U.page_id, lambda u: U.is_page(u, c.included_paths, c.excluded_paths), U.is_web, lambda u: U.is_allowed(u, ["h"]))
    assert got == [("12", True, True, True), (None, True, True, True), (None, True, True, True), (None, False, True, True), (None, False, True, True), (None, False, False, False)]


def test_names(spark):
    rows = [("Straße über 1,000 Æon", "https://h/x"), (" ", "https://h/p?pageId=5"), (None, "https://h/Some/Path/"), ("???", "https://h/"), ("", "https://h")]
    got = values(spark, rows, U.safe_name, lambda t, u: U.root_name(u))
    assert got == [("strasse-uber-1000-aeon", "x"), ("page-5", "page-5"), ("some-path", "path"), ("untitled", "docs"), ("untitled", "docs")]
    assert one(spark, "a" * 99 + " b", lambda x: T.slug(x, 100)) == "a" * 99


def test_join(spark):
    base = "https://h/a/b"
    rows = [(base, h) for h in ("/c", "c", "../c", "//i/c", "https://j/k", "#f", "?q", "/x/../y")]
    from urllib.parse import urljoin

    assert [g[0] for g in values(spark, rows, U.join)] == [urljoin(b, h) for b, h in rows]


def test_content_hash_skips_volatile_fields_only(spark):
    a = 'title: "x"\nscraped_at: "2020"\nsection:   "s"\nbody'
    same, other, inline = a.replace("2020", "2021"), a.replace("body", "bode"), a + '\nin scraped_at: "1"'
    h = [one(spark, x, T.content_hash) for x in (a, same, other, inline, inline.replace('"1"', '"2"'))]
    assert h[0] == h[1] != h[2] and h[3] != h[4] and len(h[0]) == 16


def test_front_matter(spark):
    t = '---\ntitle: "A: \\"b\\""\nkey: 1\nkey: 2\nno colon\nbreadcrumb: ["x", "y"]\n---\n\nBody\n---\nmore\n'
    assert one(spark, t, T.fields) == {"title": 'A: \\"b\\', "key": "2", "breadcrumb": '["x", "y"]'}
    assert one(spark, t, T.body) == "Body\n---\nmore"
    assert one(spark, "no front", T.fields) == {} and one(spark, "no front ", T.body) == "no front "
    assert one(spark, '["x", "y z"]', T.parse_breadcrumb) == ["x", "y z"]
    assert one(spark, "", lambda x: T.with_chunk(x, F.lit(1), F.lit(2), F.lit('s "q"'))) == '---\nchunk: "1/2"\nsection: "s \\"q\\""\n---\n\n'
    assert one(spark, '---\ntitle: "x"\n---\n\n', lambda x: T.with_chunk(x, F.lit(1), F.lit(2), F.lit("s"))) == '---\ntitle: "x"\nchunk: "1/2"\nsection: "s"\n---\n\n'


def test_noise_plain_and_titles(spark):
    noisy = "a  \n\n\n\nb [ ](x) c ![](y)\nLog in here\nSkip to main content\nend"
    assert one(spark, noisy, T.clean_noise) == "a\nb \n c !\n\n\n\nend"
    assert one(spark, "# *Hi* [name](u) `x` > y", T.plain) == "Hi name x  y"
    assert one(spark, "Page - Docs Site", lambda x: T.title_without_site(x, "Docs.*")) == "Page"
    assert one(spark, "Page |", T.title_without_site) == "Page"
    assert one(spark, "foo-bar.chunk-01.md", T.display_name) == "Foo Bar Chunk 01"
    assert one(spark, " one\n\n\n\ntwo ", T.paragraphs) == ["one", "two"]
    assert (T.extension("pdf"), T.extension("?")) == (".pdf", ".md")
    assert one(spark, " \t\n", T.word_count) == 0 and one(spark, None, T.word_count) == 0


@pytest.mark.parametrize("bad", [dict(max_depth=0), dict(chunk_overlap_words=1500), dict(max_chunk_words=0), dict(output_format="doc"), dict(max_workers=0)])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        Config(**bad)
