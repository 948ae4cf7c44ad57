"""Pages and chunks as Markdown, text, HTML, CSV rows and PDF.

Input columns: title, url, scraped_at (strings), breadcrumb (array of strings),
body (Markdown); chunk ("i/n") and section where pages are chunked. Nulls are
empty. Markdown stays in the JVM, and so do text and CSV where their plain form is
that of T.plain(), which only takes markup characters out; HTML bodies, rendered
plain text (the default of convert()) and PDF take an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .. import storage
from ..functions import text as T
from . import markdown, pdf

CSV_FIELDS = ("title", "source_url", "scraped_at", "breadcrumb", "chunk", "section", "content")

_STYLE = "body{font:16px/1.6 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}pre{overflow:auto}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.3rem .6rem}.about{color:#666;font-size:.85rem}"


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _crumbs() -> Column:
    return F.coalesce(F.col("breadcrumb"), F.array().cast("array<string>"))


def md(chunked: bool = False) -> Column:
    block = T.header(_c("title"), _c("url"), _c("scraped_at"), _crumbs())
    if chunked:
        place = F.split(F.col("chunk"), "/")
        block = F.when(F.col("chunk").isNotNull(), T.with_chunk(block, place[0], place[1], _c("section"))).otherwise(block)
    return F.concat(block, _c("body"))


@F.pandas_udf(StringType())
def _plain(body: pd.Series) -> pd.Series:
    return body.map(lambda b: markdown.to_plain(b or ""))


def plain_text() -> Column:
    """The body's text as a reader of the rendered page sees it: tables and fences keep their words."""
    return _plain(_c("body"))


def txt(plain: Column | None = None) -> Column:
    when = lambda on, *parts: F.when(on, F.concat(*parts))
    lines = [
        when(_c("title") != "", _c("title"), F.lit("\n"), F.repeat(F.lit("="), F.length(_c("title"))), F.lit("\n")),
        when(F.size(_crumbs()) > 0, F.lit("Section: "), F.array_join(_crumbs(), " > "), F.lit("\n")),
        when(_c("url") != "", F.lit("Source: "), _c("url"), F.lit("\n")),
        when(_c("scraped_at") != "", F.lit("Scraped: "), _c("scraped_at"), F.lit("\n")),
        F.concat(F.lit("\n"), T.plain(_c("body")) if plain is None else plain),
    ]
    return F.concat_ws("\n", *lines)


@F.pandas_udf(StringType())
def body_html(body: pd.Series) -> pd.Series:
    return body.map(lambda b: markdown.to_html(b or ""))


def page_html(content: Column) -> Column:
    """A page of its own around an HTML body; titles and addresses are escaped."""
    title, url, at = (T.escape_html(_c(n)) for n in ("title", "url", "scraped_at"))
    crumbs = F.array_join(F.transform(_crumbs(), T.escape_html), " &rsaquo; ")
    nav = F.when(F.size(_crumbs()) > 0, F.concat(F.lit('<nav class="breadcrumb">'), crumbs, F.lit("</nav>\n"))).otherwise("")
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<meta name="source_url" content="'), url,
        F.lit('">\n<meta name="scraped_at" content="'), at, F.lit('">\n<title>'), title, F.lit(f"</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n"), nav,
        F.lit("<h1>"), title, F.lit('</h1>\n<p class="about">Source: <a href="'), url, F.lit('">'), url, F.lit("</a> &mdash; Scraped: "), at, F.lit("</p>\n"),
        content, F.lit("\n</body>\n</html>\n"),
    )


def html() -> Column:
    return page_html(body_html(_c("body")))


def csv_rows(pages: DataFrame, plain: Column | None = None) -> DataFrame:
    """The seven columns, all strings, nulls as empty."""
    crumbs = F.when(F.size(_crumbs()) > 0, T.breadcrumb_list(_crumbs())).otherwise("")
    extra = [_c(n) if n in pages.columns else F.lit("") for n in ("chunk", "section")]
    values = [_c("title"), _c("url"), _c("scraped_at"), crumbs, *extra, T.plain(_c("body")) if plain is None else plain]
    return pages.select(*(v.alias(n) for v, n in zip(values, CSV_FIELDS)))


def shared_font(font: bytes | None = None) -> Broadcast:
    """A font's file for all executors; without one, the first that the driver finds. Empty: Helvetica.

    Batches are bounded from here on: a PDF, with its font, is many times the text it is made of."""
    storage.small_batches(SparkSession.active())
    return SparkSession.active().sparkContext.broadcast(pdf.find_font() if font is None else font)


def pdf_bytes(plain: Column | None = None, font: bytes | None = None) -> Column:
    shared = shared_font(font)

    @F.pandas_udf(BinaryType())
    def make(title: pd.Series, url: pd.Series, at: pd.Series, crumbs: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([pdf.document([pdf.page(t, u, s, list(c), p)], shared.value) for t, u, s, c, p in zip(title, url, at, crumbs, text)], dtype=object)

    return make(_c("title"), _c("url"), _c("scraped_at"), _crumbs(), T.plain(_c("body")) if plain is None else plain)


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """The lines of PDFs that this library wrote."""
    return content.map(lambda raw: None if raw is None else pdf.text(raw))


@F.pandas_udf(StringType())
def pdf_alphabet(content: pd.Series) -> pd.Series:
    """The characters of PDFs, or of their first parts, by number."""
    return content.map(pdf.alphabet)


@F.pandas_udf(StringType())
def pdf_part_text(content: pd.Series, alphabet: pd.Series) -> pd.Series:
    """The lines in parts of PDFs. alphabet: that of the PDF."""
    return pd.Series([pdf.text(raw, known) for raw, known in zip(content, alphabet)], dtype=object)


def convert(fmt: str, chunked: bool = False) -> Column:
    """The payload of a page in a format; an unknown one gives Markdown."""
    if fmt == "txt":
        return txt(plain_text())
    if fmt == "pdf":
        return pdf_bytes(plain_text())
    return html() if fmt == "html" else md(chunked)


def parse(pages: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """title, url, scraped_at, breadcrumb and body of written Markdown; the title of a page without one is its file's stem."""
    fields, stem = T.fields(F.col(content)), F.regexp_replace(F.regexp_replace(F.col(path), r"^.*/", ""), r"\.[^.]*$", "")
    rows = pages.select(path, fields.alias("_f"), T.body(F.col(content)).alias("body"), stem.alias("_stem"))
    get = lambda k: F.coalesce(F.col("_f")[k], F.lit(""))
    crumbs = F.when(get("breadcrumb") != "", T.parse_breadcrumb(get("breadcrumb"))).otherwise(F.array().cast("array<string>"))
    return rows.select(path, F.coalesce(F.col("_f")["title"], F.col("_stem")).alias("title"), get("source_url").alias("url"), get("scraped_at").alias("scraped_at"), crumbs.alias("breadcrumb"), "body")
