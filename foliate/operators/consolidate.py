"""Many pages as one document, in order of path, and an index of written files.

Input: path, title, url, scraped_at, breadcrumb, body. One document is one row
and so one task by nature; its size is bounded by what one row may hold. For
corpora beyond that give ``by`` (such as a folder column): one document a group,
or take md_parts(), txt_parts(), html_parts() and index_parts(), which give the
same text in parts of a bounded number of pages that no task sees together, or
pdf_parts(), which gives a PDF in pieces of bounded size that no task holds together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from .. import storage
from ..functions import text as T
from . import pdf, render
from .order import ranked, streamed

#: Files that are no pages.
META_NAMES = ("_index.md", "_index.txt", "_index.html", "_pages.csv", "_all.md", "_all.txt", "_all.html", "_all.pdf")
META_SUFFIXES = (".json", ".log", ".csv")
#: Names of an index in parts.
INDEX_PART = r"^_index\.part-[0-9]+\.md$"
RULE = "=" * 80


def name_of(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def candidates(files: DataFrame, extension: str) -> DataFrame:
    """Files (path) of an extension that are pages."""
    return files.where(~name_of(F.col("path")).isin(*META_NAMES) & ~name_of(F.col("path")).rlike(INDEX_PART) & ~suffix_of(F.col("path")).isin(*META_SUFFIXES) & (suffix_of(F.col("path")) == extension))


def _join(rows: DataFrame, block: Column, by: list[str]) -> DataFrame:
    """by, n, text: the blocks of each group in order of path."""
    parts = F.array_sort(F.collect_list(F.struct("path", block.alias("block"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("text"))


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def md(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n, content."""
    by = by or []
    return _join(pages, _md_block(), by).where("n > 0").select(*by, "n", F.concat(_md_start(), "text").alias("content"))


def _md_block() -> Column:
    source = F.when(_c("url") != "", F.concat(F.lit("> **Source:** ["), _c("url"), F.lit("]("), _c("url"), F.lit(")\n\n"))).otherwise("")
    return F.concat(F.lit("## "), _c("title"), F.lit("\n\n"), source, T.strip(_c("body")), F.lit("\n\n---\n"))


def _md_start() -> Column:
    return F.concat(F.lit('---\ntitle: "Consolidated Documentation"\n---\n\n# Consolidated Documentation\n\n*'), F.col("n").cast("string"), F.lit(" pages merged.*\n\n---\n\n"))


def txt(pages: DataFrame, by: list[str] | None = None, plain: Column | None = None) -> DataFrame:
    by = by or []
    return _join(pages, _txt_block(plain), by).where("n > 0").select(*by, "n", F.concat(_txt_start(), "text").alias("content"))


def _txt_block(plain: Column | None) -> Column:
    source = F.when(_c("url") != "", F.concat(F.lit("Source: "), _c("url"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit(f"{RULE}\n"), _c("title"), F.lit(f"\n{RULE}\n"), source, T.plain(_c("body")) if plain is None else plain, F.lit("\n"))


def _txt_start() -> Column:
    return F.concat(F.lit(f"CONSOLIDATED DOCUMENTATION\n{RULE}\n"), F.col("n").cast("string"), F.lit(f" pages merged.\n{RULE}\n\n"))


def html(pages: DataFrame, by: list[str] | None = None, body: Column | None = None) -> DataFrame:
    """A list of contents and a section per page, anchored page-1, page-2 and so on. body: HTML of the page."""
    by = by or []
    rows = pages.withColumn("_body", body if body is not None else render.body_html(_c("body")))
    parts = F.array_sort(F.collect_list(F.struct("path", _html_item(F.lit("{i}")).alias("item"), _html_section(F.lit("{i}")).alias("section"))))
    rows = rows.groupBy(*by).agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 0")

    def numbered(name: str, sep: str) -> Column:
        # the anchor is the first place of the mark, before any text of the page
        return F.array_join(F.transform("parts", lambda p, i: F.concat(F.substring_index(p[name], "{i}", 1), (i + 1).cast("string"), F.substr(p[name], F.locate("{i}", p[name]) + 3))), sep)

    content = F.concat(_html_start(), numbered("item", "\n"), F.lit(_HTML_MIDDLE), numbered("section", "\n\n"), F.lit(_HTML_END))
    return rows.select(*by, "n", content.alias("content"))


def _html_item(number: Column) -> Column:
    return F.concat(F.lit('<li><a href="#page-'), number, F.lit('">'), T.escape_html(_c("title")), F.lit("</a></li>"))


def _html_section(number: Column) -> Column:
    url, at = T.escape_html(_c("url")), T.escape_html(_c("scraped_at"))
    source = F.when(url != "", F.concat(F.lit('Source: <a href="'), url, F.lit('">'), url, F.lit("</a>")))
    about = F.concat_ws(" &mdash; ", source, F.when(at != "", F.concat(F.lit("Scraped: "), at)))
    return F.concat(F.lit('<section id="page-'), number, F.lit('">\n<h1>'), T.escape_html(_c("title")), F.lit('</h1>\n<div class="about">'), about, F.lit("</div>\n"), F.col("_body"), F.lit("\n</section>"))


def _html_start() -> Column:
    return F.concat(
        F.lit(f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>Consolidated Documentation</title>\n<style>{render._STYLE}</style>\n</head>\n<body>\n<nav>\n<h2>Contents ('),
        F.col("n").cast("string"), F.lit(" pages)</h2>\n<ol>\n"),
    )


_HTML_MIDDLE = "\n</ol>\n</nav>\n<main>\n"
_HTML_END = "\n</main>\n</body>\n</html>\n"

#: Pages or lines in a part.
PER_PART = 1000


def _with_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row."""
    key = F.lit(1).alias("_k")
    return rows.withColumn("_k", key).join(F.broadcast(one.withColumn("_k", key)), "_k").drop("_k")


def _parts(rows: DataFrame, lines: list[tuple[Column, str, Column | None, Column | None]], per_part: int) -> DataFrame:
    """part (bigint, from 0), n and content: each kind of line (line, separator, text before all, text behind all) over all
    rows in order of path, one kind after another. Contents one behind another are the whole document."""
    placed = ranked(rows, "path")
    n = placed.agg(F.count("*").alias("n"))
    part = F.floor(F.col("rank") / per_part)
    out = None
    for k, (line, sep, before, after) in enumerate(lines):
        own = placed.select(part.alias("_part"), "rank", line.alias("line")).groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"), F.max("rank").alias("last"))
        own = _with_row(own, n)
        text = F.array_join(F.transform("lines", lambda x: x["line"]), sep)
        first = F.when(F.col("_part") == 0, before if before is not None else F.lit("")).otherwise("")
        end = F.when(F.col("last") == F.col("n") - 1, after if after is not None else F.lit("")).otherwise(F.lit(sep))
        count = F.ceil(F.col("n") / per_part)
        own = own.select((F.lit(k) * count + F.col("_part")).cast("bigint").alias("part"), F.size("lines").cast("bigint").alias("n"), F.concat(first, text, end).alias("content"))
        out = own if out is None else out.unionByName(own)
    return out


def md_parts(pages: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """md() of all pages in parts: part, n (pages in it), content."""
    return _parts(pages, [(_md_block(), "\n", _md_start(), None)], per_part)


def txt_parts(pages: DataFrame, per_part: int = PER_PART, plain: Column | None = None) -> DataFrame:
    return _parts(pages, [(_txt_block(plain), "\n", _txt_start(), None)], per_part)


def html_parts(pages: DataFrame, per_part: int = PER_PART, body: Column | None = None) -> DataFrame:
    """html() of all pages in parts: first those of the list of contents, then those of the sections."""
    rows = pages.withColumn("_body", body if body is not None else render.body_html(_c("body")))
    number = (F.col("rank") + 1).cast("string")
    return _parts(rows, [(_html_item(number), "\n", _html_start(), F.lit(_HTML_MIDDLE)), (_html_section(number), "\n\n", None, F.lit(_HTML_END))], per_part)


def pdf_document(pages: DataFrame, by: list[str] | None = None, plain: Column | None = None, font: bytes | None = None) -> DataFrame:
    """One PDF, each page's text on new sheets. It is one row, which one task makes; pdf_parts() has no such row."""
    by, shared = by or [], render.shared_font(font)

    @F.pandas_udf(BinaryType())
    def make(parts: pd.Series) -> pd.Series:
        return pd.Series([pdf.document((pdf.page(p["title"], p["url"], "", list(p["breadcrumb"]), p["plain"], 16) for p in doc), shared.value) for doc in parts], dtype=object)

    crumbs = F.coalesce("breadcrumb", F.array().cast("array<string>"))
    text = T.plain(_c("body")) if plain is None else plain
    rows = pages.select(*by, "path", _c("title").alias("title"), _c("url").alias("url"), crumbs.alias("breadcrumb"), text.alias("plain"))
    parts = F.array_sort(F.collect_list(F.struct("path", "title", "url", "breadcrumb", "plain")))
    rows = rows.groupBy(*by).agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 0")
    return rows.select(*by, "n", make("parts").alias("content"))


def _with_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group, of which there is one row in groups; nulls of by are a group too."""
    named = groups.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), *(c for c in groups.columns if c not in by))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(named, on).drop(*(f"_by{i}" for i in range(len(by))))


def pdf_parts(pages: DataFrame, by: list[str] | None = None, plain: Column | None = None, font: bytes | None = None, most: int = pdf.PIECE) -> DataFrame:
    """The PDF of each group in parts: by, part (bigint, from 0), n (pages that begin in it), content. Contents one behind another are the file.

    A part ends where it has reached most bytes, but cuts no sheet. Pages are drawn one by one in all tasks; the sheets of a
    group then pass one task in order of path, which numbers them and holds a part and the places of objects. Characters
    are numbered by code point. Two tables are written once in between: the pages' text and the characters of groups.
    """
    by, shared = by or [], render.shared_font(font)

    @F.pandas_udf(ArrayType(StringType()))
    def letters(title: pd.Series, url: pd.Series, crumbs: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([list(set(" ").union(*(line for line, _, _ in pdf.page(t, u, "", list(c), p, 16))) - {"\n"}) for t, u, c, p in zip(title, url, crumbs, text)], dtype=object)

    @F.pandas_udf(ArrayType(BinaryType()))
    def draw(title: pd.Series, url: pd.Series, crumbs: pd.Series, text: pd.Series, alphabet: pd.Series) -> pd.Series:
        faces = {a: pdf.typeface(shared.value, a) for a in alphabet.unique()}
        return pd.Series([list(pdf.sheets(pdf.page(t, u, "", list(c), p, 16), faces[a])) for t, u, c, p, a in zip(title, url, crumbs, text, alphabet)], dtype=object)

    def write(rows: Iterator[dict]) -> Iterator[dict]:
        begun = 0

        def drawn() -> Iterator[bytes]:
            nonlocal begun
            for row in rows:
                begun += 1
                yield from row["_sheets"]

        fonts = pdf.typeface(shared.value, next(rows)["_alphabet"]).objects(3)  # the group's own row comes first
        for part, content in enumerate(pdf.pieces(drawn(), fonts, most)):
            yield {"part": part, "n": begun, "content": content}
            begun = 0

    crumbs = F.coalesce("breadcrumb", F.array().cast("array<string>"))
    text = T.plain(_c("body")) if plain is None else plain
    rows = pages.select(*by, F.col("path").alias("_path"), _c("title").alias("_title"), _c("url").alias("_url"), crumbs.alias("_crumbs"), text.alias("_text"))
    rows = storage.save(rows.repartition("_path"), "pdf-pages", **storage.SMALL_GROUPS)
    shown = ("_title", "_url", "_crumbs", "_text")
    groups = rows.select(*by, F.explode(letters(*shown)).alias("_c")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("_c")), "").alias("_alphabet"))
    groups = storage.save(groups.where("_alphabet <> ''"), "pdf-alphabets")  # a page has a blank at least
    drawn = _with_group(rows, groups, by).select(*by, "_path", "_title", "_url", draw(*shown, "_alphabet").alias("_sheets"))
    drawn = drawn.withColumn("_page", F.lit(1)).unionByName(groups.withColumn("_page", F.lit(0)), allowMissingColumns=True)
    schema = StructType().add("part", LongType()).add("n", LongType()).add("content", BinaryType())
    return streamed(drawn, by, ["_page", "_path", "_title", "_url"], write, schema)


def pdf_parts_text(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, part, n, text: the lines in each of pdf_parts(), which should be a table saved with storage.SMALL_GROUPS.

    That is read twice, and by its row groups a large group's file is read by several tasks."""
    by = by or []
    groups = storage.save(parts.where("part = 0").select(*by, render.pdf_alphabet("content").alias("_alphabet")), "pdf-alphabets")
    return _with_group(parts, groups, by).select(*by, "part", "n", render.pdf_part_text("content", "_alphabet").alias("text"))


def digests(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n and digest (SHA-256 in hexadecimal) of texts in parts (by, part, n, text) one behind another, which no task holds together."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        n, digest = 0, hashlib.sha256()
        for row in rows:
            n += row["n"]
            digest.update(row["text"].encode())
        yield {"n": n, "digest": digest.hexdigest()}

    by = by or []
    return streamed(parts.select(*by, "part", "n", "text"), by, ["part"], step, StructType().add("n", LongType()).add("digest", StringType()))


def companions(pdfs: DataFrame, markdown: DataFrame) -> DataFrame:
    """path and content for each PDF: the Markdown of the same stem, or a header with the stem as title."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    texts = markdown.select(stem(F.col("path")).alias("_stem"), F.col("content"))
    rows = pdfs.select("path", stem(F.col("path")).alias("_stem")).join(texts, "_stem", "left")
    stub = F.concat(F.lit('---\ntitle: "'), name_of(F.col("_stem")), F.lit('"\n---\n'))
    return rows.select("path", F.coalesce("content", stub).alias("content"))


def consolidate(pages: DataFrame, fmt: str, by: list[str] | None = None) -> DataFrame | None:
    """by, n, content; no row without pages, and None for CSV, which is one file anyway."""
    if fmt in ("md", "html"):
        return (md if fmt == "md" else html)(pages, by)
    if fmt in ("txt", "pdf"):
        # the UDF's column is taken first: it can't stand inside an aggregate
        rows = pages.withColumn("_plain", render.plain_text())
        return (txt if fmt == "txt" else pdf_document)(rows, by, F.col("_plain"))
    return None


def index(files: DataFrame, stats: DataFrame) -> DataFrame:
    """One row (content): counters, then the files (path, relative) by folder in order of path."""
    lines = _index_lines(files)
    listing = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("listing"))
    return _with_row(listing, stats).select(F.concat(_index_start(), "listing").alias("content"))


def _index_lines(files: DataFrame) -> DataFrame:
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    rows = files.select("path", folder.alias("folder"))
    rows = rows.join(rows.groupBy("folder").agg(F.min("path").alias("first")), "folder")
    entry = F.concat(F.lit("- ["), T.display_name(name_of(F.col("path"))), F.lit("]("), F.col("path"), F.lit(")"))
    head = F.when((F.col("path") == F.col("first")) & (F.col("folder") != ""), F.concat(F.lit("\n## "), F.col("folder"), F.lit("\n\n"))).otherwise("")
    return rows.select("path", F.concat(head, entry).alias("line"))


def _index_start() -> Column:
    counters = F.concat(
        F.lit("Pages written: **"), F.col("ok").cast("string"), F.lit("**  |  Unchanged: **"), F.col("unchanged").cast("string"),
        F.lit("**  |  Skipped: **"), F.col("skipped").cast("string"), F.lit("**  |  Errors: **"), F.col("error").cast("string"), F.lit("**\n\n"),
    )
    return F.concat(F.lit('---\ntitle: "Documentation Index"\n---\n\n# Documentation Index\n\n'), counters)


def index_parts(files: DataFrame, stats: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """index() in parts: part, n (files in it), content."""
    lines = _with_row(_index_lines(files), stats.select(_index_start().alias("start")))
    first = F.when(F.col("rank") == 0, F.concat("start", "line")).otherwise(F.col("line"))
    return _parts(lines, [(first, "\n", None, None)], per_part)
