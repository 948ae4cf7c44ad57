"""PDFs with an embedded font: text that comes back, the font file in them, and the fallback; rendered plain text."""

import hashlib
import re
import struct
import time
import zlib

import pytest
from foliate.operators import consolidate, markdown, pdf, render
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

FONT = pdf.find_font()
needs_font = pytest.mark.skipif(FONT is None, reason="no TrueType font on this machine")
TEXTS = ["Ελληνικά και άλλα", "Русский текст, ёж", "árvíztűrő tükörfúrógép ŁÓDŹ", "back\\slash (round) <angle>", "東京 \U0001f600", "tab\tand no-break\xa0space", ""]


@needs_font
@pytest.mark.parametrize("text", TEXTS)
def test_text_comes_back_as_it_was(text):
    out = pdf.document([[(text, 11, 0.0)]], FONT)
    assert pdf.text(out) == text
    at = int(out.rsplit(b"startxref\n", 1)[1].split()[0])
    assert out[at : at + 4] == b"xref"


@needs_font
def test_embedded_font_has_the_glyphs_used_and_no_others():
    out = pdf.document([[("Aé", 11, 0.0)]], FONT)
    streams = [zlib.decompress(m[1]) for m in re.finditer(rb"(?s)FlateDecode >>\nstream\n(.*?)\nendstream\nendobj", out)]
    (raw,) = [s for s in streams if s[:4] == b"\0\1\0\0"]
    whole = pdf.TrueType(FONT)
    part = {}
    for i in range(struct.unpack(">H", raw[4:6])[0]):
        tag, total, start, length = struct.unpack(">4sLLL", raw[12 + 16 * i : 28 + 16 * i])
        data = raw[start : start + length]
        padded = data + b"\0" * (-len(data) % 4)
        assert sum(struct.unpack(f">{len(padded) // 4}L", padded)) & 0xFFFFFFFF == total
        part[tag] = data
    places = struct.unpack(f">{len(part[b'loca']) // 4}L", part[b"loca"])
    filled = {g for g in range(len(places) - 1) if places[g] < places[g + 1]}
    wanted = {whole.glyph[ord(c)] for c in "Aé "}
    composed = whole._with_parts(wanted)
    assert filled <= composed and {g for g in wanted if whole._outline(g)} <= filled and len(composed) < 12
    assert 500 < whole.width(whole.glyph[ord("A")]) < 800
    assert len(out) < 40_000


@needs_font
def test_lines_fit_and_long_words_are_cut():
    font = pdf.true_type(FONT)
    face = pdf._Embedded(font)
    room = (pdf.WIDTH - 2 * pdf.MARGIN) * 1000 / 11
    lines = pdf._wrap("wörd " * 500 + "\n\n" + "Ω" * 1000, 11, face)
    assert all(sum(map(face.width, line)) <= room for line in lines) and lines.count([]) >= 1
    back = {k: c for c, k in face.number.items()}
    assert "".join(back[k] for line in lines for k in line).replace(" ", "") == "wörd" * 500 + "Ω" * 1000
    began = time.time()
    pdf._wrap("x" * 300_000, 11, face)
    assert time.time() - began < 5


def test_without_a_font():
    out = pdf.document([[("Tïtle (a) \\ 東", 11, 0.0)]])
    assert pdf.text(out) == "Tïtle (a) \\ ?" and b"/Helvetica" in out and len(out) < 2000


@needs_font
def test_columns(spark):
    rows = spark.createDataFrame([("a", "Ёж", "u", None, ["x"], "| k | v |\n|---|---|\n| один | δύο |\n\n```\nlet x = 1\n```"), ("b", None, None, None, None, None)], "path string, title string, url string, scraped_at string, breadcrumb array<string>, body string")
    got = {r.path: r.t for r in rows.select("path", render.pdf_text(render.convert("pdf")).alias("t")).collect()}
    assert got == {"a": "Ёж\nx\nSource: u\nk\tv\nодин\tδύο\nlet x = 1", "b": ""}
    assert "\nk\tv\nодин\tδύο\n\nlet x = 1" in rows.where("path = 'a'").select(render.convert("txt").alias("t")).first().t
    assert rows.where("path = 'a'").select(render.pdf_text(render.pdf_bytes(font=b"")).alias("t")).first().t.startswith("??\nx")
    one = consolidate.consolidate(rows, "pdf").select("n", render.pdf_text("content").alias("t")).first()
    assert one.n == 2 and "один\tδύο" in one.t
    assert "k\tv\nодин\tδύο\n\nlet x = 1" in consolidate.consolidate(rows, "txt").first().content
    table = render.csv_rows(rows, render.plain_text()).where("title = 'Ёж'").first()
    assert table.content == "k\tv\nодин\tδύο\n\nlet x = 1"


def test_plain_text_of_every_block():
    text = "# A & *b*\n\np **x [l](u)** `c<d>` ![alt](s)\nline\n\n- a\n- b\n  - c\n  more\n\n1. d\n\n| h | k |\n|---|---|\n| 1\\|2 | **3** |\n\n```\n<code> # *no*\n\n  | x |\n```\n\n> q\n> > r\n\n---\nend * of ** it"
    assert markdown.to_plain(text) == "A & b\n\np x l c<d> alt\nline\n\na\nb\nc more\n\nd\n\nh\tk\n1|2\t3\n\n<code> # *no*\n\n  | x |\n\nq\n\nr\n\nend * of ** it"
    assert markdown.to_plain("") == "" and markdown.to_html("") == ""


def test_markup_that_nests_or_repeats_without_end():
    began = time.time()
    assert markdown.to_plain(">" * 5000 + " x") == "x"
    assert markdown.to_html("\n".join(" " * i + "- x" for i in range(3000))).count("<li>") == 3000
    assert markdown.to_plain("[" * 200_000) == "[" * 200_000
    assert markdown.to_plain("```\nopen") == "open"
    assert time.time() - began < 5


def test_a_page_with_clashing_columns(spark):
    rows = spark.createDataFrame([("t", "u", "b", "x", "y")], "title string, url string, body string, _plain string, plain string").withColumns({"scraped_at": F.lit(""), "breadcrumb": F.array(F.lit("c")), "path": F.lit("p")})
    assert "b" in consolidate.consolidate(rows, "txt").first().content
    assert consolidate.consolidate(rows, "pdf").select(render.pdf_text("content").alias("t")).first().t == "t\nc\nSource: u\nb"


def test_batches_of_pdfs_are_bounded(spark):
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "64m")
        spark.conf.set(keys[1], "10000")
        pages = spark.range(3000).repartition(1).select(F.lit("t").alias("title"), F.lit("").alias("url"), F.lit("").alias("scraped_at"), F.array().cast("array<string>").alias("breadcrumb"), F.lit("b").alias("body"))
        render.pdf_bytes(font=b"")

        @F.pandas_udf("int")
        def rows(x):
            return x.map(lambda _: len(x))

        assert pages.select(rows("body").alias("n")).agg(F.max("n")).head()[0] <= 1000
        assert pages.select(rows(F.repeat("body", F.lit(10_000))).alias("n")).agg(F.max("n")).head()[0] <= 105
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pages_are_packed_one_at_a_time(monkeypatch):
    held, packed = [], []
    pack = pdf._stream
    monkeypatch.setattr(pdf, "_stream", lambda data: packed.append(1) or pack(data))

    def parts():
        for i in range(40):
            held.append(i - len(packed))
            yield [(f"page {i}", 11, 0.0)]

    assert pdf.text(pdf.document(parts())).split("\n") == [f"page {i}" for i in range(40)]
    assert max(held) <= 1


PAGES = "path string, host string, title string, url string, scraped_at string, breadcrumb array<string>, body string"


def _many(spark):
    """Pages of three hosts, one of them null and one with long texts of other characters."""
    rows = [(f"{h}/{i:04d}", h, f"T{i} {x}", f"http://{h}/{i}" if i % 3 else None, None, ["c", x] if i % 2 else None, f"{x} word{i} " * (900 if h == "b" else 3) + "\n\n# end\n(a)\\") for h, x, n in (("a", "é", 60), ("b", "Ёж 東\U0001f600", 30), (None, "z", 5)) for i in range(n)]
    return spark.createDataFrame(rows, PAGES).repartition(5, F.hash("title"))


def _files(parts, by):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        out.setdefault(r[by] if by else None, []).append(r)
    return out


@pytest.mark.parametrize("font", [None, b""])
def test_parts_of_a_pdf_are_one_file(spark, font):
    pages = _many(spark)
    whole = {r.host: r for r in consolidate.pdf_document(pages, ["host"], font=font).select("*", render.pdf_text("content").alias("t")).collect()}
    parts = consolidate.storage.save(consolidate.pdf_parts(pages, ["host"], font=font, most=4000), "parts")
    files = _files(parts, "host")
    assert set(files) == {"a", "b", None}
    for host, own in files.items():
        raw = b"".join(bytes(r.content) for r in own)
        assert [r.part for r in own] == list(range(len(own))) and (host is None or len(own) > 2) and sum(r.n for r in own) == whole[host].n
        assert pdf.text(raw) == whole[host].t
        # no part but the first, with the font, holds more than a sheet beyond what was asked for
        assert all(len(r.content) < 4000 + 12_000 for r in own[1:])
        table = raw[int(raw.rsplit(b"startxref\n", 1)[1].split()[0]) :].split(b"trailer")[0].splitlines()[2:]
        assert all(raw[int(line[:10]) :].startswith(b"%d 0 obj\n" % i) for i, line in enumerate(table[1:], 1))
        kids = re.search(rb"/Kids \[([^]]*)\] /Count (\d+)", raw)
        assert kids[1].count(b" 0 R") == int(kids[2]) == raw.count(b"/Type /Page ")
    texts = consolidate.pdf_parts_text(parts, ["host"])
    lines = _files(texts, "host")
    assert all("\n".join(r.text for r in own if r.text) == re.sub(r"\n+", "\n", whole[host].t) for host, own in lines.items())
    joined = {host: hashlib.sha256("".join(r.text for r in own).encode()).hexdigest() for host, own in lines.items()}
    assert {r.host: (r.n, r.digest) for r in consolidate.digests(texts, ["host"]).collect()} == {host: (whole[host].n, joined[host]) for host in joined}


def test_parts_of_one_pdf_of_all_pages(spark):
    pages = _many(spark)
    whole = consolidate.pdf_document(pages).select("n", render.pdf_text("content").alias("t")).first()
    parts = consolidate.pdf_parts(pages, most=4000)
    assert parts.columns == ["part", "n", "content"]
    (own,) = _files(parts, None).values()
    assert pdf.text(b"".join(bytes(r.content) for r in own)) == whole.t and sum(r.n for r in own) == whole.n == 95
    assert consolidate.pdf_parts(pages.limit(0)).count() == consolidate.pdf_parts(pages.limit(0), ["host"]).count() == 0


def test_no_row_of_consolidate_pdf_holds_a_host(spark, tmp_path):
    from foliate.plans.queries import QUERIES

    words = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(200))
    rows = [(i, f"http://one.org/{i}", f"<title>T{i}</title><p>{i} {words}</p>") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    widest, take = [], consolidate.storage.save
    held = lambda df: F.greatest(*(F.length(F.col(f.name).cast("string")) if isinstance(f.dataType, ArrayType) else F.length(f.name) for f in df.schema if isinstance(f.dataType, (ArrayType, BinaryType, StringType))))

    def save(df, name, **options):
        out = take(df, name, **options)
        widest.append(out.agg(F.max(held(out))).first()[0])
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(consolidate.storage, "save", save)
        result = QUERIES["consolidate_pdf"](spark, str(tmp_path))
        (row,) = result.collect()
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert (row.host, row.n, row.magic) == ("one.org", 400, "%PDF-") and "collect_list" not in plan
    assert len(widest) == 4 and max(widest) < 400_000  # the host's text has 2,600,000 characters
