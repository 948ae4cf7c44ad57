"""Texts: words, front matter, noise, hashes, slugs, plain form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their plain forms; ligatures are replaced first.
_ACCENTED = "àáâãäåāăąçćčďèéêëēĕėęěìíîïĩīįñńňòóôõöøōőŕřśšșťțùúûüũūůűųýÿžźżłğ"
_PLAIN = "aaaaaaaaacccdeeeeeeeeeiiiiiiinnnoooooooorrsssttuuuuuuuuuyyzzzlg"
_LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d"))

#: What is taken out of converted pages, in this order, each with a line feed put in its place.
NOISE = (
    r"\n{3,}",
    r"[ \t]+\n",
    r"\[\s*\]\([^)]*\)",
    r"!\[\s*\]\([^)]*\)",
    r"Tempo aproximado para leitura[^\n]*\n?",
    r"assistive\.skiplink\.[^\n]*\n?",
    r"Skip to main content[^\n]*\n?",
    r"Log in[^\n]*\n?",
)
#: Front-matter fields that differ between runs of one page.
VOLATILE = r'(?dm)^(scraped_at|chunk|section):[ \t]*"[^"]*"$'
#: Fixed value: the front matter of a page.
_BLOCK = r"(?s)^---\n(.*?)\n---\n?"
EXTENSIONS = {"md": ".md", "txt": ".txt", "html": ".html", "csv": ".csv", "pdf": ".pdf"}


#: Noise patterns that take a search for each place of a run of blanks, and forms with the same matches that take one a run.
_LINEAR = {r"[ \t]+\n": r"(?<![ \t])[ \t]++\n"}
_BLANK = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("bigint")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 without the volatile fields' values."""
    return F.left(F.sha2(F.regexp_replace(text, VOLATILE, '$1: ""'), 256), F.lit(16))


def clean_noise(text: Column) -> Column:
    for pattern in NOISE:
        text = F.regexp_replace(text, _LINEAR.get(pattern, pattern), "\n")
    return strip(text)


def title_without_site(title: Column, site_names: str = "") -> Column:
    """Without a trailing "-" or "|" and the site's name after it."""
    return strip(F.regexp_replace(title, rf"(?<!\s)\s*+[-|]\s*({site_names})?$", ""))


def slug(text: Column, length: int) -> Column:
    text = F.lower(text)
    for a, b in _LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"([0-9]),([0-9])", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.left(text, F.lit(length)), r"-+$", "")


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def front_matter(text: Column) -> Column:
    """The block between the first two lines of three dashes, without them; empty if there is none."""
    return F.regexp_extract(text, _BLOCK, 1)


def has_front_matter(text: Column) -> Column:
    return text.rlike(_BLOCK)


def fields(text: Column) -> Column:
    """Front-matter fields as a map of strings; of repeated keys the last counts."""
    lines = F.filter(F.split(front_matter(text), "\n"), lambda x: x.contains(":"))
    key = lambda x: strip(F.substring_index(x, ":", 1))
    value = lambda x: F.trim(strip(F.substr(x, F.locate(":", x) + 1)), F.lit('"'))
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    """What follows the front matter, stripped; the text itself if there is none."""
    return F.when(has_front_matter(text), strip(F.regexp_replace(text, _BLOCK, ""))).otherwise(text)


def plain(markdown: Column) -> Column:
    """Without markup characters, links unwrapped, stripped."""
    text = F.regexp_replace(markdown, r"[#*`_~>]+", "")
    return strip(F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def breadcrumb_list(titles: Column) -> Column:
    """["a", "b"] of an array of titles."""
    quoted = F.transform(titles, lambda t: F.concat(F.lit('"'), escape_quotes(t), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def parse_breadcrumb(text: Column) -> Column:
    """Titles of ["a", "b"]."""
    bare = F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(strip(p), F.lit('"'))), lambda p: p != "")


def header(title: Column, url: Column, scraped_at: Column, breadcrumb: Column) -> Column:
    """Front matter of a page, with the empty line after it."""
    crumb = F.when(F.size(breadcrumb) > 0, F.concat(F.lit("breadcrumb: "), breadcrumb_list(breadcrumb)))
    quoted = lambda k, v: F.concat(F.lit(f'{k}: "'), v, F.lit('"'))
    lines = [F.lit("---"), quoted("title", escape_quotes(title)), quoted("source_url", url), quoted("scraped_at", scraped_at), crumb, F.lit("---")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def with_chunk(block: Column, index: Column, total: Column, section: Column) -> Column:
    """Front matter (dashes included, or empty) with the chunk's place and section in it."""
    extra = F.concat(F.lit('chunk: "'), index.cast("string"), F.lit("/"), total.cast("string"), F.lit('"\nsection: "'), escape_quotes(section), F.lit('"\n'))
    bare = F.regexp_replace(block, r"\n+$", "")
    inside = F.concat(F.regexp_replace(bare, r"---$", ""), extra, F.lit("---\n\n"))
    return F.when(F.coalesce(block, F.lit("")) == "", F.concat(F.lit("---\n"), extra, F.lit("---\n\n"))).otherwise(inside)


def display_name(name: Column) -> Column:
    """Title-cased file name without its extension's dot form: a-b.chunk-01.md gives A B Chunk 01."""
    return F.initcap(F.replace(F.replace(F.replace(name, F.lit(".md"), F.lit("")), F.lit("-"), F.lit(" ")), F.lit("."), F.lit(" ")))


def extension(fmt: str) -> str:
    return EXTENSIONS.get(fmt, ".md")


def iso_time(at: Column) -> Column:
    """UTC, to the second; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def page_title(html: Column) -> Column:
    """Text of the first <title>, white space collapsed."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return strip(F.regexp_replace(found, r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Text outside comments, scripts, styles, noscript and head, tags taken as spaces, white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "head"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return strip(F.regexp_replace(text, r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"'), 1)
