"""One query per operator over the whole pages or documents table, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import Config
from ..functions import text as T
from ..functions import urls as U
from ..operators import chunk, consolidate, crawl, html, render, state
from ..sources import files, seeds
from ..sources import pages as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2026-01-02T03:04:05Z"
INCLUDED, EXCLUDED = ("/en/", "/de/"), ("/en/1", "/s/")
SMALL = Config(max_chunk_words=100, chunk_overlap_words=20)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# DuckDB spellings of the column functions


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _count(x: str) -> str:
    return f"CAST(len({_words(x)}) AS BIGINT)"


def _host(u: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^[^:/?#]+://([^/?#]*)', 1), '(?s)^.*@', ''), ':[0-9]*$', ''))"


def _path(u: str) -> str:
    return rf"regexp_replace(regexp_extract({u}, '(?s)^[^:/?#]+:(//[^/?#]*)?([^?#]*)', 2), '(?s);[^/]*$', '')"


def _query(u: str) -> str:
    return rf"regexp_extract({u}, '(?s)^[^?#]*\?([^#]*)', 1)"


def _canonical(u: str) -> str:
    q = _query(u)
    return rf"('https://' || {_host(u)} || regexp_replace({_path(u)}, '/+$', '') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def _title(h: str) -> str:
    return _strip(rf"regexp_replace(regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')")


def _visible(h: str) -> str:
    x = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "head"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
    return _strip(x)


_VOLATILE = r"""'(?m)^(scraped_at|chunk|section):[ \t]*"[^"]*"$', '\1: ""', 'g'"""


def _hash(x: str) -> str:
    return f"left(sha256(regexp_replace({x}, {_VOLATILE})), 16)"


def _slug(x: str, n: int) -> str:
    x = f"lower({x})"
    for a, b in T._LIGATURES:
        x = f"replace({x}, '{a}', '{b}')"
    x = rf"regexp_replace(translate({x}, '{T._ACCENTED}', '{T._PLAIN}'), '([0-9]),([0-9])', '\1\2', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"regexp_replace(left({x}, {n}), '-+$', '')"


def _plain(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({x}, '[#*`_~>]+', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')")


def _noise(x: str) -> str:
    for p in T.NOISE:
        x = f"regexp_replace({x}, '{p}', chr(10), 'g')"
    return _strip(x)


def _escape(x: str) -> str:
    return f"""replace({x}, '"', '\\"')"""


def _html(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


# pages as sources of canonical documents


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """path, url, title, scraped_at, breadcrumb and body of every page; each third has a breadcrumb."""
    url = U.canonical(F.col("url"))
    crumbs = F.when(F.col("page_id") % 3 == 0, F.array(U.host(F.col("url")), F.lit('a "quoted" part'))).otherwise(F.array().cast("array<string>"))
    return _pages(spark, d).select(
        "page_id",
        F.concat(U.host(F.col("url")), F.lit("/"), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(".md")).alias("path"),
        url.alias("url"),
        T.page_title("html").alias("title"),
        F.lit(NOW).alias("scraped_at"),
        crumbs.alias("breadcrumb"),
        T.visible_text("html").alias("body"),
    )


_RENDERED = f"""rendered AS (
  SELECT page_id, {_host('url')} || '/' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '.md' AS path, {_canonical('url')} AS url,
    {_title('html')} AS title, '{NOW}' AS scraped_at,
    CASE WHEN page_id % 3 = 0 THEN [{_host('url')}, 'a "quoted" part'] ELSE CAST([] AS VARCHAR[]) END AS breadcrumb,
    {_visible('html')} AS body
  FROM pages)"""
_CRUMBS = """CASE WHEN len(breadcrumb) > 0 THEN '["' || array_to_string(list_transform(breadcrumb, lambda b: replace(b, '"', '\\"')), '", "') || '"]' END"""
_HEADER = f"""('---' || chr(10) || 'title: "' || {_escape('title')} || '"' || chr(10) || 'source_url: "' || url || '"' || chr(10)
  || 'scraped_at: "' || scraped_at || '"' || chr(10) || coalesce('breadcrumb: ' || {_CRUMBS} || chr(10), '') || '---' || chr(10) || chr(10))"""


@query(f"SELECT page_id, {_canonical('url')} AS url, {_title('html')} AS title, {_count(_visible('html'))} AS n_words, {_hash(_visible('html'))} AS hash FROM pages")
def page_profile(spark, d):
    rows = _pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("url"), T.page_title("html").alias("title"), T.visible_text("html").alias("text"))
    return rows.select("page_id", "url", "title", T.word_count(F.col("text")).alias("n_words"), T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT page_id, {_canonical('url')} AS canonical FROM pages")
def url_canonical(spark, d):
    return _pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT {_canonical('url')} AS canonical, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1 HAVING count(*) > 1")
def url_canonical_dups(spark, d):
    rows = _pages(spark, d).groupBy(U.canonical(F.col("url")).alias("canonical"))
    return rows.agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")


@query(f"SELECT page_id, {_host('url')} AS host, {_host('url')} IN (SELECT {_host('url')} FROM pages WHERE page_id < 20) AS allowed FROM pages")
def url_host_scope(spark, d):
    hosts = _pages(spark, d).where("page_id < 20").select(U.host(F.col("url")).alias("host")).distinct().withColumn("allowed", F.lit(True))
    rows = _pages(spark, d).select("page_id", U.host(F.col("url")).alias("host"))
    return rows.join(hosts, "host", "left").select("page_id", "host", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query(f"SELECT page_id, {_path('url')} AS path FROM pages WHERE regexp_matches({_path('url')}, '^(/en/|/de/|/en$|/de$)') AND NOT regexp_matches({_path('url')}, '^(/en/1|/s/)')")
def page_path_filter(spark, d):
    rows = _pages(spark, d).where(U.is_page(F.col("url"), INCLUDED, EXCLUDED))
    return rows.select("page_id", U.path(F.col("url")).alias("path"))


@query("SELECT page_id, nullif(regexp_extract(url, '(?i)[?&]page=([0-9]+)', 1), '') AS number FROM pages")
def page_id_extract(spark, d):
    return _pages(spark, d).select("page_id", U.page_id(F.col("url"), "page").alias("number"))


_LINKS = """links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1)) AS href,
    unnest(range(len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1)))) AS position
  FROM pages)"""


@query(f"WITH {_LINKS} SELECT page_id, CAST(position AS BIGINT) AS position, href FROM links")
def link_explode(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(T.links(F.col("html"))).alias("position", "href")).select("page_id", F.col("position").cast("bigint"), "href")


_RESOLVED = f"""resolved AS (
  SELECT page_id, position, {_canonical("regexp_extract(url, '(?s)^([^:/?#]+://[^/?#]*)', 1) || href")} AS target FROM links WHERE href LIKE '/%' AND href NOT LIKE '//%')"""


@query(f"WITH {_LINKS}, {_RESOLVED} SELECT page_id, target, CAST(min(position) AS BIGINT) AS position FROM resolved GROUP BY page_id, target")
def link_resolve_distinct(spark, d):
    rows = _pages(spark, d).select("page_id", "url", F.posexplode(T.links(F.col("html"))).alias("position", "href")).where("href like '/%' and href not like '//%'")
    rows = rows.where(U.is_web(F.col("href"))).select("page_id", "position", U.canonical(U.join(F.col("url"), F.col("href"))).alias("target"))
    return rows.groupBy("page_id", "target").agg(F.min("position").cast("bigint").alias("position"))


@query(f"SELECT page_id, sha256({_visible('html')}) AS digest, {_count(_visible('html'))} AS n_words FROM pages")
def visible_text(spark, d):
    rows = _pages(spark, d).select("page_id", T.visible_text("html").alias("text"))
    return rows.select("page_id", F.sha2("text", 256).alias("digest"), T.word_count(F.col("text")).alias("n_words"))


_NOISY = "'Log in now' || chr(10) || replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10) || chr(10) || '[ ](x) ![](y) ') || chr(10) || 'Skip to main content x' || chr(10) || 'assistive.skiplink.a' || chr(10) || 'Tempo aproximado para leitura: 5'"


@query(f"SELECT doc_id, sha256({_noise('noisy')}) AS digest, CAST(length({_noise('noisy')}) AS BIGINT) AS n FROM (SELECT doc_id, {_NOISY} AS noisy FROM documents)")
def noise_clean(spark, d):
    noisy = F.concat(F.lit("Log in now\n"), F.replace("text", F.lit(". "), F.lit(".  \n\n\n\n[ ](x) ![](y) ")), F.lit("\nSkip to main content x\nassistive.skiplink.a\nTempo aproximado para leitura: 5"))
    rows = _docs(spark, d).select("doc_id", T.clean_noise(noisy).alias("clean"))
    return rows.select("doc_id", F.sha2("clean", 256).alias("digest"), F.length("clean").cast("bigint").alias("n"))


_ROOT = _slug("list_filter(string_split(" + _path("url") + ", '/'), lambda x: x <> '')[-1]", 80)


@query(f"""SELECT page_id, {_slug(_title('html'), 100)} AS slug, coalesce(nullif({_slug(_title('html'), 100)}, ''), nullif({_slug("replace(" + _path('url') + ", '/', '-')", 100)}, ''), 'untitled') AS file,
  coalesce({_ROOT}, 'docs') AS root FROM pages""")
def slug(spark, d):
    title = T.page_title("html")
    return _pages(spark, d).select("page_id", T.slug(title, 100).alias("slug"), U.safe_name(title, F.col("url")).alias("file"), U.root_name(F.col("url")).alias("root"))


@query(f"""SELECT doc_id, {_hash("'scraped_at: \"x\"' || chr(10) || text || chr(10) || 'section: \"y\"'")} AS hash, {_hash("'scraped_at: \"other\"' || chr(10) || text || chr(10) || 'section: \"\"'")} AS again FROM documents""")
def content_hash(spark, d):
    with_fields = lambda a, b: F.concat(F.lit(f'scraped_at: "{a}"\n'), "text", F.lit(f'\nsection: "{b}"'))
    return _docs(spark, d).select("doc_id", T.content_hash(with_fields("x", "y")).alias("hash"), T.content_hash(with_fields("other", "")).alias("again"))


@query(f"SELECT doc_id, {_count('text')} AS n_words FROM documents")
def word_count(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(f"SELECT {_count('text')} <= 1500 AS short, count(*) AS n, CAST(sum({_count('text')}) AS BIGINT) AS n_words FROM documents GROUP BY 1")
def short_page_split(spark, d):
    n = T.word_count(F.col("text"))
    return _docs(spark, d).select((n <= 1500).alias("short"), n.alias("w")).groupBy("short").agg(F.count("*").alias("n"), F.sum("w").alias("n_words"))


@query(f"""SELECT doc_id, CAST(s AS BIGINT) AS start, array_to_string(ws[s + 1:s + 1500], ' ') AS content
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 1400)) AS s FROM (SELECT doc_id, {_words('text')} AS ws FROM documents) WHERE len(ws) > 1500)""")
def word_windows(spark, d):
    c = Config()
    rows = _docs(spark, d).where(T.word_count(F.col("text")) > c.max_chunk_words).select("doc_id", F.posexplode(chunk.windows(T.words(F.col("text")), c.max_chunk_words, c.chunk_overlap_words)).alias("i", "w"))
    return rows.select("doc_id", (F.col("i") * (c.max_chunk_words - c.chunk_overlap_words)).cast("bigint").alias("start"), F.array_join("w", " ").alias("content"))


def _marked() -> F.Column:
    """Every fourth line becomes a heading, of level 2 to 4."""
    line = lambda x, i: F.when(i % 4 == 2, F.concat(F.repeat(F.lit("#"), (i % 3 + 2).cast("int")), F.lit(" "), x)).otherwise(x)
    return F.array_join(F.transform(F.split("text", "\n"), line), "\n")


_MARKED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 2 THEN repeat('#', CAST((i - 1) % 3 + 2 AS BIGINT)) || ' ' || x ELSE x END), chr(10))"


def _sections(bodies: str) -> str:
    """bodies: SELECT of doc_id and body."""
    return f"""
marked AS ({bodies}),{_NAMED}"""


_NAMED = rf"""
cut AS (
  SELECT doc_id, string_split(regexp_replace(body, '(?m)^(#{{1,4}})\s+(.+)$', chr(1) || chr(2) || '\1' || chr(2) || chr(3) || '\2' || chr(3) || chr(1), 'g'), chr(1) || chr(2)) AS parts FROM marked),
part AS (SELECT doc_id, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM cut),
named AS (
  SELECT doc_id, i, CASE WHEN i = 0 THEN 'Introdução' ELSE {_strip("split_part(split_part(p, chr(3) || chr(1), 1), chr(2) || chr(3), 2)")} END AS heading,
    CAST(CASE WHEN i = 0 THEN 1 ELSE length(split_part(p, chr(2) || chr(3), 1)) END AS INTEGER) AS level,
    {_strip("CASE WHEN i = 0 THEN p ELSE substr(p, strpos(p, chr(3) || chr(1)) + 2) END")} AS content
  FROM part),
sections AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, heading, level, content, {_count('content')} AS n FROM named WHERE content <> '')"""
_SECTIONS = _sections(f"SELECT doc_id, {_MARKED} AS body FROM documents")


@query(f"WITH {_SECTIONS} SELECT doc_id, k, heading, level, n, sha256(content) AS digest FROM sections")
def section_parse(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(chunk.sections(_marked())).alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("k"), "s.heading", "s.level", "s.n", F.sha2("s.content", 256).alias("digest"))



def _fold(most: int) -> str:
    return f"""
fold AS (
  SELECT doc_id, k, n, CAST(1 AS BIGINT) AS id, CASE WHEN n <= {most} THEN n ELSE 0 END AS buf FROM sections WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.k, s.n, CASE WHEN f.buf > 0 AND f.buf + s.n <= {most} THEN f.id ELSE f.id + 1 END,
    CASE WHEN f.buf > 0 AND f.buf + s.n <= {most} THEN f.buf + s.n WHEN s.n <= {most} THEN s.n ELSE 0 END
  FROM fold f JOIN sections s ON s.doc_id = f.doc_id AND s.k = f.k + 1)"""


_FOLD = _fold(100)


@query(f"WITH RECURSIVE {_SECTIONS}, {_FOLD} SELECT doc_id, id, CAST(min(k) AS BIGINT) AS first, count(*) AS n_sections, CAST(sum(n) AS BIGINT) AS n_words FROM fold GROUP BY doc_id, id")
def section_greedy_merge(spark, d):
    rows = _docs(spark, d).select("doc_id", chunk.sections(_marked()).alias("s"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(chunk.fold(F.transform("s", lambda s: s["n"]), 100).alias("id"), F.col("s"))).alias("i", "z"))
    return rows.groupBy("doc_id", F.col("z.id").cast("bigint").alias("id")).agg(
        (F.min("i") + 1).cast("bigint").alias("first"), F.count("*").alias("n_sections"), F.sum("z.s.n").alias("n_words")
    )



def _chunks(most: int, step: int) -> str:
    return f"""
joined AS (
  SELECT doc_id, id, CAST(1 AS BIGINT) AS part, arg_min(heading, k) AS section, string_agg(content, chr(10) || chr(10) ORDER BY k) AS content, max(s.n) AS most
  FROM fold f JOIN sections s USING (doc_id, k) GROUP BY doc_id, id),
windowed AS (
  SELECT doc_id, id, s // {step} + 1 AS part, section || CASE WHEN s > 0 THEN ' (parte ' || CAST(s // {step} + 1 AS VARCHAR) || ')' ELSE '' END AS section, array_to_string(ws[s + 1:s + {most}], ' ') AS content
  FROM (SELECT doc_id, id, section, ws, unnest(range(0, len(ws), {step})) AS s FROM (SELECT doc_id, id, section, {_words('content')} AS ws FROM joined WHERE most > {most}))),
every AS (SELECT doc_id, id, part, section, content FROM joined WHERE most <= {most} UNION ALL SELECT doc_id, id, part, section, content FROM windowed),
numbered AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY id, part) AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total, section, content FROM every),
chunked AS (
  SELECT m.doc_id, coalesce(chunk_index, 1) AS chunk_index, coalesce(chunk_total, 1) AS chunk_total, section, coalesce(content, m.body) AS content
  FROM marked m LEFT JOIN numbered n ON m.doc_id = n.doc_id AND n.chunk_total > 1 AND {_count('m.body')} > {most})"""


_CHUNKS = _chunks(100, 80)


@query(f"WITH RECURSIVE {_SECTIONS}, {_FOLD}, {_CHUNKS} SELECT doc_id, chunk_index, chunk_total, section, sha256(content) AS digest FROM chunked")
def chunk_rows(spark, d):
    rows = chunk.chunk_rows(_docs(spark, d).select("doc_id", _marked().alias("body")), SMALL)
    return rows.select("doc_id", "chunk_index", "chunk_total", "section", F.sha2("content", 256).alias("digest"))


@query(f"""WITH {_RENDERED}
SELECT page_id, rtrim({_escape('title')}, '"') AS title, url AS source_url, scraped_at, coalesce({_CRUMBS}, '') AS breadcrumb,
  CAST(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_crumbs, sha256(body) AS body_digest
FROM (SELECT * REPLACE (ltrim(title, '"') AS title) FROM rendered)""")
def frontmatter_roundtrip(spark, d):
    rows = _rendered(spark, d).select("page_id", render.md().alias("content"))
    f = T.fields(F.col("content"))
    rows = rows.select("page_id", f.alias("f"), T.body(F.col("content")).alias("body"))
    crumbs = F.coalesce(F.col("f")["breadcrumb"], F.lit(""))
    return rows.select(
        "page_id", F.col("f")["title"].alias("title"), F.col("f")["source_url"].alias("source_url"), F.col("f")["scraped_at"].alias("scraped_at"), crumbs.alias("breadcrumb"),
        F.when(crumbs != "", F.size(T.parse_breadcrumb(crumbs))).otherwise(0).cast("bigint").alias("n_crumbs"), F.sha2("body", 256).alias("body_digest"),
    )


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """A tree by page_id with back edges and self-loops: url, title, children in order."""
    rows = _pages(spark, d).select("page_id", T.page_title("html").alias("title"))
    name = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 9, "0"))
    tree = rows.where("page_id > 0").select(name(F.expr("(page_id - 1) div 3")).alias("url"), name(F.col("page_id")).alias("child"), F.col("page_id").alias("position"))
    back = rows.select(name(F.col("page_id")).alias("url"), name(F.expr("page_id div 2")).alias("child"), (F.col("page_id") + 1_000_000_000).alias("position"))
    skip = rows.where("page_id > 4").select(name(F.expr("page_id div 5")).alias("url"), name(F.col("page_id")).alias("child"), (F.col("page_id") + 2_000_000_000).alias("position"))
    children = tree.union(back).union(skip).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "child"))), lambda x: x["child"]).alias("children"))
    return rows.select(name(F.col("page_id")).alias("url"), F.when(F.col("page_id") % 7 != 3, F.col("title")).otherwise("").alias("title")).join(children, "url", "left")


_EDGES = """nodes AS (SELECT page_id, 'p' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS url, CASE WHEN page_id % 7 <> 3 THEN """ + _title("html") + """ ELSE '' END AS title FROM pages),
edges AS (
  SELECT (page_id - 1) // 3 AS src, page_id AS dst FROM pages WHERE page_id > 0
  UNION SELECT page_id, page_id // 2 FROM pages UNION SELECT page_id // 5, page_id FROM pages WHERE page_id > 4),
walk AS (SELECT CAST(0 AS BIGINT) AS id, 1 AS depth UNION SELECT e.dst, depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE depth < 5),
levels AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
parents AS (
  SELECT l.id, l.depth, min(p.id) AS parent FROM levels l LEFT JOIN edges e ON e.dst = l.id AND l.depth > 1 LEFT JOIN levels p ON p.id = e.src AND p.depth = l.depth - 1 GROUP BY l.id, l.depth)"""


def _crawled(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("p000000000", "root", 0)], "url string, root string, root_order bigint")
    return crawl.crawl_store(roots, storage.save(_graph(spark, d), "graph"), 5)


_FOREST = """forest AS (
  SELECT page_id AS id, CAST(1 AS BIGINT) AS depth, page_id AS root_order, CAST(NULL AS BIGINT) AS parent FROM pages WHERE page_id % 20 = 7),
spread AS (SELECT id, depth FROM forest UNION SELECT e.dst, depth + 1 FROM spread w JOIN edges e ON e.src = w.id WHERE depth < 4),
nearest AS (SELECT id, min(depth) AS depth FROM spread GROUP BY id),
told AS (
  SELECT * FROM forest
  UNION ALL
  SELECT l.id, l.depth, min(w.root_order * 1000000000 + w.id) // 1000000000, min(w.root_order * 1000000000 + w.id) % 1000000000
  FROM told w JOIN edges e ON e.src = w.id JOIN nearest l ON l.id = e.dst AND l.depth = w.depth + 1 GROUP BY l.id, l.depth)"""


@query(f"WITH RECURSIVE {_EDGES}, {_FOREST} SELECT n.url, t.depth, 'r' || CAST(t.root_order AS VARCHAR) AS root, q.url AS parent_url FROM told t JOIN nodes n ON n.page_id = t.id LEFT JOIN nodes q ON q.page_id = t.parent")
def crawl_forest(spark, d):
    """From every twentieth page, so that the roots and what they reach grow with the table."""
    order = F.col("page_id")
    roots = _pages(spark, d).where("page_id % 20 = 7").select(F.concat(F.lit("p"), F.lpad(order.cast("string"), 9, "0")).alias("url"), F.concat(F.lit("r"), order.cast("string")).alias("root"), order.alias("root_order"))
    found = crawl.crawl_store(roots, storage.save(_graph(spark, d), "graph"), 4)
    return found.select("url", F.col("depth").cast("bigint").alias("depth"), "root", "parent_url")


@query(f"WITH RECURSIVE {_EDGES} SELECT n.url, CAST(p.depth AS BIGINT) AS depth, q.url AS parent_url FROM parents p JOIN nodes n ON n.page_id = p.id LEFT JOIN nodes q ON q.page_id = p.parent")
def crawl_levels(spark, d):
    return _crawled(spark, d).select("url", F.col("depth").cast("bigint").alias("depth"), "parent_url")


@query(f"""WITH RECURSIVE {_EDGES},
chain AS (
  SELECT p.id, p.depth, '' AS crumbs FROM parents p WHERE p.depth = 1
  UNION ALL
  SELECT p.id, p.depth, c.crumbs || CASE WHEN n.title <> '' THEN CASE WHEN c.crumbs <> '' THEN ' > ' ELSE '' END || n.title ELSE '' END
  FROM chain c JOIN nodes n ON n.page_id = c.id JOIN parents p ON p.parent = c.id AND p.depth = c.depth + 1)
SELECT n.url, c.crumbs AS breadcrumb FROM chain c JOIN nodes n ON n.page_id = c.id""")
def breadcrumb(spark, d):
    return _crawled(spark, d).select("url", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


def _run_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with hash, earlier state, files that are there)."""
    now = _docs(spark, d).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "doc_id", T.content_hash(F.col("text")).alias("hash"))
    ext = F.when(F.col("doc_id") % 13 == 0, ".txt").otherwise(".md")
    rows = now.where("doc_id % 3 <> 0").withColumn("path", F.concat("url", ext))
    hash_ = F.when(F.col("doc_id") % 7 == 0, F.reverse("hash")).otherwise(F.col("hash"))
    known = rows.select("url", hash_.alias("hash"), F.array("path").alias("files"), F.lit("t").alias("title"), F.lit("2025-01-01").alias("updated_at"))
    return now, known, rows.where("doc_id % 11 <> 0").select("path")


_STATUS = f"""now AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS url, doc_id, {_hash('text')} AS hash FROM documents),
judged AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'new'
    WHEN (CASE WHEN doc_id % 7 = 0 THEN reverse(hash) ELSE hash END) = hash AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'unchanged' ELSE 'changed' END AS status
  FROM now)"""


@query(f"WITH {_STATUS} SELECT url, status FROM judged")
def incremental_status(spark, d):
    now, known, there = _run_state(spark, d)
    return state.classify(now, known, there, ".md").select("url", "status")


@query(f"""WITH {_STATUS} SELECT url, hash, CASE WHEN status = 'unchanged' THEN '2025-01-01' ELSE '{NOW}' END AS updated_at FROM judged""")
def state_upsert(spark, d):
    now, known, there = _run_state(spark, d)
    fresh = state.classify(now, known, there, ".md").where("status <> 'unchanged'")
    fresh = fresh.select("url", "hash", F.array(F.concat("url", F.lit(".md"))).alias("files"), F.lit("t").alias("title"), F.lit(NOW).alias("updated_at"))
    return state.upsert(known, fresh).select("url", "hash", "updated_at")


@query("SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS url FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0")
def state_tombstones(spark, d):
    now, known, _ = _run_state(spark, d)
    return state.tombstones(known, now.where("doc_id % 5 <> 0")).select("url")


@query(f"""WITH {_STATUS} SELECT count(*) FILTER (WHERE status IN ('new', 'changed')) AS ok, count(*) FILTER (WHERE status = 'unchanged') AS unchanged,
  CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS error FROM judged""")
def crawl_stats(spark, d):
    now, known, there = _run_state(spark, d)
    return crawl.stats(state.classify(now, known, there, ".md"))


@query("SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS url, {'hash': 'x'}.hash AS hash, CAST(1 AS BIGINT) AS n_files FROM documents WHERE doc_id % 3 <> 0")
def state_json_roundtrip(spark, d):
    _, known, _ = _run_state(spark, d)
    back = state.from_json(state.to_json(known.withColumn("hash", F.lit("x"))))
    return back.select("url", "hash", F.size("files").cast("bigint").alias("n_files"))


@query(f"""WITH {_RENDERED} SELECT title, url AS source_url, scraped_at, coalesce({_CRUMBS}, '') AS breadcrumb, '' AS chunk, '' AS section, {_plain('body')} AS content FROM rendered""")
def csv_rows(spark, d):
    return render.csv_rows(_rendered(spark, d))


@query(f"""WITH {_RENDERED} SELECT page_id, concat_ws(chr(10),
  CASE WHEN title <> '' THEN title || chr(10) || repeat('=', length(title)) || chr(10) END,
  CASE WHEN len(breadcrumb) > 0 THEN 'Section: ' || array_to_string(breadcrumb, ' > ') || chr(10) END,
  CASE WHEN url <> '' THEN 'Source: ' || url || chr(10) END, 'Scraped: ' || scraped_at || chr(10), chr(10) || {_plain('body')}) AS content FROM rendered""")
def txt_render(spark, d):
    return _rendered(spark, d).select("page_id", render.txt().alias("content"))


@query(f"WITH {_RENDERED} SELECT page_id, {_HEADER} || body AS content FROM rendered")
def md_render(spark, d):
    return _rendered(spark, d).select("page_id", render.md().alias("content"))


@query(f"""WITH {_RENDERED} SELECT page_id, sha256({_HEADER}) AS header, sha256(left({_HEADER}, length({_HEADER}) - 5) || 'chunk: "2/3"' || chr(10) || 'section: "' || {_escape('title')} || '"' || chr(10) || '---' || chr(10) || chr(10) || body) AS digest FROM rendered""")
def chunk_front_matter(spark, d):
    rows = _rendered(spark, d).withColumns({"chunk": F.lit("2/3"), "section": F.col("title")})
    return rows.select("page_id", F.sha2(T.header(F.col("title"), F.col("url"), F.col("scraped_at"), F.col("breadcrumb")), 256).alias("header"), F.sha2(render.md(True), 256).alias("digest"))


_PAGE_HTML = f"""'<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<meta name="source_url" content="' || {_html('url')}
  || '">' || chr(10) || '<meta name="scraped_at" content="' || scraped_at || '">' || chr(10) || '<title>' || {_html('title')} || '</title>' || chr(10) || '<style>{render._STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
  || CASE WHEN len(breadcrumb) > 0 THEN '<nav class="breadcrumb">' || {_html("array_to_string(breadcrumb, chr(1))").replace("&gt;", "&gt;")} || '</nav>' || chr(10) ELSE '' END
  || '<h1>' || {_html('title')} || '</h1>' || chr(10) || '<p class="about">Source: <a href="' || {_html('url')} || '">' || {_html('url')} || '</a> &mdash; Scraped: ' || scraped_at || '</p>' || chr(10)
  || '<p>' || {_html('body')} || '</p>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)"""


@query(f"WITH {_RENDERED} SELECT page_id, replace({_PAGE_HTML}, chr(1), ' &rsaquo; ') AS content FROM rendered")
def html_render(spark, d):
    return _rendered(spark, d).select("page_id", render.page_html(F.concat(F.lit("<p>"), T.escape_html(F.col("body")), F.lit("</p>"))).alias("content"))


def _structured(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose body is a heading, a table, a fence, a list, a quote and a paragraph around words of the page."""
    rows = _rendered(spark, d).withColumn("w", F.trim(F.regexp_replace("body", "[^A-Za-z0-9]+", " "))).withColumn("i", F.col("page_id").cast("string"))
    body = F.concat(
        F.lit("## Page "), "i", F.lit("\n\n| Key | Value |\n| --- | --- |\n| number | "), "i", F.lit(" |\n| text | x "), "w", F.lit(" |\n\n```\nlet a = <b> & "), "i", F.lit("\n\n  *c*\n```\n\n- one "), "i",
        F.lit("\n- [two](/t)\n  - three\n\n> said **so**\n\nSome **bold "), "w", F.lit("** and `code "), "i", F.lit("`.\nNext line."),
    )
    return rows.withColumn("body", body)


_STRUCTURED = f"""{_RENDERED}, structured AS (
  SELECT *, trim(regexp_replace(body, '[^A-Za-z0-9]+', ' ', 'g')) AS w, CAST(page_id AS VARCHAR) AS i FROM rendered)"""
_BODY_HTML = """'<h2>Page ' || i || '</h2>' || chr(10) || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>Key</th><th>Value</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10)
  || '<tr><td>number</td><td>' || i || '</td></tr>' || chr(10) || '<tr><td>text</td><td>' || rtrim('x ' || w) || '</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10)
  || '<pre><code>let a = &lt;b&gt; &amp; ' || i || chr(10) || chr(10) || '  *c*' || chr(10) || '</code></pre>' || chr(10) || '<ul>' || chr(10) || '<li>one ' || i || '</li>' || chr(10)
  || '<li><a href="/t">two</a>' || chr(10) || '<ul>' || chr(10) || '<li>three</li>' || chr(10) || '</ul></li>' || chr(10) || '</ul>' || chr(10)
  || '<blockquote>' || chr(10) || '<p>said <strong>so</strong></p>' || chr(10) || '</blockquote>' || chr(10) || '<p>Some <strong>bold ' || w || '</strong> and <code>code ' || i || '</code>.<br />' || chr(10) || 'Next line.</p>'"""
_BODY_PLAIN = """'Page ' || i || chr(10) || chr(10) || 'Key' || chr(9) || 'Value' || chr(10) || 'number' || chr(9) || i || chr(10) || 'text' || chr(9) || rtrim('x ' || w) || chr(10) || chr(10)
  || 'let a = <b> & ' || i || chr(10) || chr(10) || '  *c*' || chr(10) || chr(10) || 'one ' || i || chr(10) || 'two' || chr(10) || 'three' || chr(10) || chr(10) || 'said so' || chr(10) || chr(10)
  || 'Some bold ' || w || ' and code ' || i || '.' || chr(10) || 'Next line.'"""
_BARE = r"regexp_replace({}, '[ \t\n\r\f\v]+', '', 'g')"


def _bare(text: Column) -> Column:
    """Without white space: lines of a PDF end where they are full."""
    return F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", "")


def _magic(name: str) -> Column:
    return F.decode(F.substring(name, 1, 5), "UTF-8").alias("magic")


@query(f"WITH {_STRUCTURED} SELECT page_id, replace({_PAGE_HTML}, chr(1), ' &rsaquo; ') AS content FROM structured".replace("'<p>' || " + _html("body") + " || '</p>'", _BODY_HTML))
def html_render_markdown(spark, d):
    """The full renderer over bodies of every kind of block."""
    return _structured(spark, d).select("page_id", render.html().alias("content"))


@query(f"WITH {_STRUCTURED} SELECT page_id, {_BODY_PLAIN} AS content FROM structured")
def plain_text_rendered(spark, d):
    return _structured(spark, d).select("page_id", render.plain_text().alias("content"))


_SHEET = f"title || array_to_string(breadcrumb, ' > ') || 'Source: ' || url || {{}} || {_plain('body')}"


@query(f"WITH {_RENDERED} SELECT page_id, '%PDF-' AS magic, sha256({_BARE.format(_SHEET.format(chr(39) + 'Scraped: ' + chr(39) + ' || scraped_at'))}) AS digest FROM rendered")
def pdf_render(spark, d):
    """Every page as PDF, and the text that is read back from it."""
    rows = _rendered(spark, d).select("page_id", render.pdf_bytes().alias("pdf"))
    return rows.select("page_id", _magic("pdf"), F.sha2(_bare(render.pdf_text("pdf")), 256).alias("digest"))


@query()
def html_extract(spark, d):
    """Title, Markdown and links of every page by the HTML tree."""
    rows = _pages(spark, d).select("page_id", html.extract(F.col("html")).alias("x"))
    return rows.select("page_id", "x.title", T.clean_noise(F.col("x.markdown")).alias("markdown"), F.size("x.hrefs").cast("bigint").alias("n_links"), "x.error")


_BY = "split_part(path, '/', 1)"


@query(f"""WITH {_RENDERED} SELECT {_BY} AS host, count(*) AS n, sha256('---' || chr(10) || 'title: "Consolidated Documentation"' || chr(10) || '---' || chr(10) || chr(10) || '# Consolidated Documentation' || chr(10) || chr(10) || '*'
  || CAST(count(*) AS VARCHAR) || ' pages merged.*' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || string_agg('## ' || title || chr(10) || chr(10) || '> **Source:** [' || url || '](' || url || ')' || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY path)) AS digest
FROM rendered GROUP BY 1""")
def consolidate_md(spark, d):
    rows = _rendered(spark, d).withColumn("host", F.substring_index("path", "/", 1))
    return consolidate.md(rows, ["host"]).select("host", "n", F.sha2("content", 256).alias("digest"))


_RULE = f"'{consolidate.RULE}'"


@query(f"""WITH {_RENDERED} SELECT {_BY} AS host, count(*) AS n, sha256('CONSOLIDATED DOCUMENTATION' || chr(10) || {_RULE} || chr(10) || CAST(count(*) AS VARCHAR) || ' pages merged.' || chr(10) || {_RULE} || chr(10) || chr(10)
  || string_agg({_RULE} || chr(10) || title || chr(10) || {_RULE} || chr(10) || 'Source: ' || url || chr(10) || {_plain('body')} || chr(10), chr(10) ORDER BY path)) AS digest
FROM rendered GROUP BY 1""")
def consolidate_txt(spark, d):
    rows = _rendered(spark, d).withColumn("host", F.substring_index("path", "/", 1))
    return consolidate.txt(rows, ["host"]).select("host", "n", F.sha2("content", 256).alias("digest"))


@query(f"""WITH {_RENDERED}, placed AS (SELECT *, {_BY} AS host, CAST(row_number() OVER (PARTITION BY {_BY} ORDER BY path) AS VARCHAR) AS k FROM rendered)
SELECT host, count(*) AS n, sha256('<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<title>Consolidated Documentation</title>' || chr(10)
  || '<style>{render._STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<nav>' || chr(10) || '<h2>Contents (' || CAST(count(*) AS VARCHAR) || ' pages)</h2>' || chr(10) || '<ol>' || chr(10)
  || string_agg('<li><a href="#page-' || k || '">' || {_html('title')} || '</a></li>', chr(10) ORDER BY path) || chr(10) || '</ol>' || chr(10) || '</nav>' || chr(10) || '<main>' || chr(10)
  || string_agg('<section id="page-' || k || '">' || chr(10) || '<h1>' || {_html('title')} || '</h1>' || chr(10) || '<div class="about">Source: <a href="' || {_html('url')} || '">' || {_html('url')} || '</a> &mdash; Scraped: '
    || scraped_at || '</div>' || chr(10) || '<pre>' || {_html('body')} || '</pre>' || chr(10) || '</section>', chr(10) || chr(10) ORDER BY path)
  || chr(10) || '</main>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS digest
FROM placed GROUP BY host""")
def consolidate_html(spark, d):
    rows = _rendered(spark, d).withColumn("host", F.substring_index("path", "/", 1))
    body = F.concat(F.lit("<pre>"), T.escape_html(F.col("body")), F.lit("</pre>"))
    return consolidate.html(rows, ["host"], body).select("host", "n", F.sha2("content", 256).alias("digest"))


@query(f"WITH {_RENDERED} SELECT {_BY} AS host, count(*) AS n, '%PDF-' AS magic, sha256({_BARE.format('string_agg(' + _SHEET.format(chr(39) * 2) + ', chr(10) ORDER BY path)')}) AS digest FROM rendered GROUP BY 1")
def consolidate_pdf(spark, d):
    rows = _rendered(spark, d).withColumn("host", F.substring_index("path", "/", 1))
    parts = storage.save(consolidate.pdf_parts(rows, ["host"]), "pdf-parts", **storage.SMALL_GROUPS)
    texts = consolidate.pdf_parts_text(parts, ["host"]).withColumn("text", _bare("text"))
    first = parts.where("part = 0").select(F.col("host").alias("of"), _magic("content"))
    return consolidate.digests(texts, ["host"]).join(first, F.col("host").eqNullSafe(F.col("of"))).select("host", "n", "magic", "digest")


@query(f"""WITH {_RENDERED}, placed AS (SELECT *, {_BY} AS folder, min(path) OVER (PARTITION BY {_BY}) AS first FROM rendered)
SELECT '---' || chr(10) || 'title: "Documentation Index"' || chr(10) || '---' || chr(10) || chr(10) || '# Documentation Index' || chr(10) || chr(10) || 'Pages written: **' || CAST(count(*) AS VARCHAR)
  || '**  |  Unchanged: **0**  |  Skipped: **0**  |  Errors: **0**' || chr(10) || chr(10)
  || string_agg(CASE WHEN path = first THEN chr(10) || '## ' || folder || chr(10) || chr(10) ELSE '' END || '- [' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '](' || path || ')', chr(10) ORDER BY path) AS content
FROM placed""")
def index_listing(spark, d):
    rows = _rendered(spark, d)
    return consolidate.index(rows.select("path"), crawl.stats(rows.select(F.lit("ok").alias("status"))))


_PLACED = f"""placed AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () AS total FROM rendered)"""


@query(f"""WITH {_RENDERED}, {_PLACED}, lines AS (
  SELECT k, total, CASE WHEN path = min(path) OVER (PARTITION BY {_BY}) THEN chr(10) || '## ' || {_BY} || chr(10) || chr(10) ELSE '' END || '- [' || lpad(CAST(page_id AS VARCHAR), 12, '0') || '](' || path || ')' AS line FROM placed)
SELECT CAST(k // 40 AS BIGINT) AS part, count(*) AS n, CASE WHEN k // 40 = 0 THEN '---' || chr(10) || 'title: "Documentation Index"' || chr(10) || '---' || chr(10) || chr(10) || '# Documentation Index' || chr(10) || chr(10) || 'Pages written: **' || CAST(max(total) AS VARCHAR)
  || '**  |  Unchanged: **0**  |  Skipped: **0**  |  Errors: **0**' || chr(10) || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY k) || CASE WHEN max(k) = max(total) - 1 THEN '' ELSE chr(10) END AS content FROM lines GROUP BY k // 40""")
def index_parts(spark, d):
    """The index in parts of forty files, which one behind another are index_listing."""
    rows = _rendered(spark, d)
    return consolidate.index_parts(rows.select("path"), crawl.stats(rows.select(F.lit("ok").alias("status"))), 40)


@query(f"""WITH {_RENDERED}, {_PLACED}, lines AS (
  SELECT k, total, 0 AS kind, '<li><a href="#page-' || CAST(k + 1 AS VARCHAR) || '">' || {_html('title')} || '</a></li>' AS line FROM placed
  UNION ALL SELECT k, total, 1, '<section id="page-' || CAST(k + 1 AS VARCHAR) || '">' || chr(10) || '<h1>' || {_html('title')} || '</h1>' || chr(10) || '<div class="about">Source: <a href="' || {_html('url')} || '">' || {_html('url')} || '</a> &mdash; Scraped: '
    || scraped_at || '</div>' || chr(10) || '<pre>' || {_html('body')} || '</pre>' || chr(10) || '</section>' FROM placed)
SELECT CAST(kind * ((max(total) + 39) // 40) + k // 40 AS BIGINT) AS part, count(*) AS n, CASE WHEN kind = 0 AND k // 40 = 0 THEN '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<title>Consolidated Documentation</title>' || chr(10)
  || '<style>{render._STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<nav>' || chr(10) || '<h2>Contents (' || CAST(max(total) AS VARCHAR) || ' pages)</h2>' || chr(10) || '<ol>' || chr(10) ELSE '' END
  || CASE WHEN kind = 0 THEN string_agg(line, chr(10) ORDER BY k) ELSE string_agg(line, chr(10) || chr(10) ORDER BY k) END
  || CASE WHEN max(k) < max(total) - 1 THEN CASE WHEN kind = 0 THEN chr(10) ELSE chr(10) || chr(10) END WHEN kind = 0 THEN chr(10) || '</ol>' || chr(10) || '</nav>' || chr(10) || '<main>' || chr(10) ELSE chr(10) || '</main>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) END AS content
FROM lines GROUP BY kind, k // 40""")
def consolidate_html_parts(spark, d):
    """One HTML document of all pages, in parts of forty lines."""
    return consolidate.html_parts(_rendered(spark, d), 40, F.concat(F.lit("<pre>"), T.escape_html(F.col("body")), F.lit("</pre>")))


_FILES = """files AS (
  SELECT 'out/' || CASE page_id % 8 WHEN 0 THEN '_index.md' WHEN 1 THEN CAST(page_id AS VARCHAR) || '.md' WHEN 2 THEN '_all.md' WHEN 3 THEN CAST(page_id AS VARCHAR) || '.json'
    WHEN 4 THEN CAST(page_id AS VARCHAR) || '.chunk-01.md' WHEN 5 THEN CAST(page_id AS VARCHAR) || '.html' WHEN 6 THEN 'md' ELSE '_pages.csv' END AS path FROM pages)"""


@query(f"WITH {_FILES} SELECT path FROM files WHERE path LIKE '%.md' AND path NOT IN ('out/_index.md', 'out/_all.md')")
def candidate_files(spark, d):
    i = F.col("page_id").cast("string")
    names = {0: F.lit("_index.md"), 1: F.concat(i, F.lit(".md")), 2: F.lit("_all.md"), 3: F.concat(i, F.lit(".json")), 4: F.concat(i, F.lit(".chunk-01.md")), 5: F.concat(i, F.lit(".html")), 6: F.lit("md")}
    name = F.lit("_pages.csv")
    for k, v in names.items():
        name = F.when(F.col("page_id") % 8 == k, v).otherwise(name)
    return consolidate.candidates(_pages(spark, d).select(F.concat(F.lit("out/"), name).alias("path")), ".md")


@query(f"SELECT doc_id, sha256({_plain(_MARKED)}) AS digest FROM documents")
def plain_text(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.plain(_marked()), 256).alias("digest"))


@query(f"""SELECT min(page_id) AS root_order, {_canonical('url')} AS url, coalesce(any_value({_ROOT}), 'docs') AS root FROM pages WHERE page_id % 10 <> 0 GROUP BY 2""")
def seed_roots(spark, d):
    line = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("  # "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    return seeds.roots(_pages(spark, d).select(F.col("page_id").alias("ord"), line.alias("line"))).select("root_order", "url", "root")


@query(f"SELECT {_host('url')} AS host, min(page_id) AS ord FROM pages WHERE page_id % 10 <> 0 GROUP BY 1")
def seed_domains(spark, d):
    line = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("#"), "url")).otherwise(F.col("url"))
    return seeds.domains(_pages(spark, d).select(F.col("page_id").alias("ord"), line.alias("line")))


@query(f"""SELECT page_id, CASE WHEN page_id % 4 > 1 THEN {_title('html')} END AS title, CASE WHEN page_id % 4 > 1 THEN sha256(html) END AS digest,
  CASE WHEN page_id % 4 > 1 THEN 'c' || CAST(page_id AS VARCHAR) END AS child FROM pages""")
def api_pages(spark, d):
    """REST answers: good ones, ones without a body, and ones that are no JSON."""
    i = F.col("page_id")
    doc = F.struct(
        T.page_title("html").alias("title"),
        F.struct(F.struct(F.when(i % 4 != 1, F.col("html")).otherwise("").alias("value")).alias("view")).alias("body"),
        F.struct(F.struct(F.array(F.struct(F.concat(F.lit("c"), i.cast("string")).alias("id")), F.struct(F.lit("").alias("id"))).alias("results")).alias("page")).alias("children"),
    )
    raw = F.when(i % 4 == 0, F.lit("<html>no json")).otherwise(F.to_json(doc))
    rows = _pages(spark, d).select("page_id", P.api_page(raw).alias("x"))
    return rows.select("page_id", "x.title", F.sha2("x.html", 256).alias("digest"), F.array_join("x.child_ids", ",").alias("child"))


@query(f"""WITH named AS (SELECT page_id, {_canonical('url')} AS url, left({_slug(_title('html'), 100)}, 1) || '.md' AS path FROM pages)
SELECT page_id, CASE WHEN url = min(url) OVER (PARTITION BY path) THEN path ELSE replace(path, '.md', '') || '-' || left(sha256(url), 8) || '.md' END AS path FROM named""")
def distinct_paths(spark, d):
    rows = _pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("url"), F.concat(F.left(T.slug(T.page_title("html"), 100), F.lit(1)), F.lit(".md")).alias("path"))
    return files.distinct_paths(rows).select("page_id", "path")


@query("""SELECT page_id, 'pdf/' || CAST(page_id AS VARCHAR) || '.pdf' AS path, CASE WHEN page_id % 2 = 0 THEN 'text ' || CAST(page_id AS VARCHAR) ELSE '---' || chr(10) || 'title: "' || CAST(page_id AS VARCHAR) || '"' || chr(10) || '---' || chr(10) END AS content FROM pages""")
def pdf_companions(spark, d):
    i = F.col("page_id").cast("string")
    pdfs = _pages(spark, d).select(F.concat(F.lit("pdf/"), i, F.lit(".pdf")).alias("path"))
    texts = _pages(spark, d).where("page_id % 2 = 0").select(F.concat(F.lit("pdf/"), i, F.lit(".md")).alias("path"), F.concat(F.lit("text "), i).alias("content"))
    rows = consolidate.companions(pdfs, texts)
    return rows.select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("page_id"), "path", "content")


def chunk_sql(bodies: str, most: int, overlap: int) -> str:
    """CTEs up to chunked (doc_id, chunk_index, chunk_total, section, content), to follow WITH RECURSIVE. bodies: SELECT of doc_id and body."""
    return f"{_sections(bodies)}, {_fold(most)}, {_chunks(most, most - overlap)}"


_OUTCOME = f"""raw AS (
  SELECT page_id, {_canonical('url')} AS u, url, CASE WHEN page_id % 7 <> 0 THEN html END AS html, CASE page_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 200 END AS status FROM pages),
one AS (SELECT u, arg_min(page_id, url) AS page_id, arg_min(coalesce(html, ''), url) AS html, arg_min(coalesce(status, 0), url) AS status FROM raw GROUP BY u),
told AS (SELECT *, CASE WHEN status IN (0, 503) THEN 'error' WHEN status = 404 OR html = '' THEN 'skipped' ELSE 'ok' END AS outcome FROM one)"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a fetch leaves them: good ones, refused ones, ones that are gone, time-outs and empty ones."""
    i = F.col("page_id")
    status = F.when(i % 5 == 0, 503).when(i % 5 == 1, 404).when(i % 5 != 2, 200)
    raw = _pages(spark, d).select("page_id", "url", F.when(i % 7 != 0, F.col("html")).alias("html"), status.alias("status"), F.when(i % 5 == 2, "timeout").alias("error"))
    return P.store(raw).withColumn("outcome", crawl.status())


@query(f"WITH {_OUTCOME} SELECT u AS url, outcome, CASE status WHEN 0 THEN 'timeout' WHEN 503 THEN 'HTTP 503' END AS error, status AS http_status FROM told")
def fetch_outcomes(spark, d):
    return _outcomes(spark, d).select("url", "outcome", "error", F.coalesce("http_status", F.lit(0)).alias("http_status"))


@query(f"WITH {_OUTCOME} SELECT count(*) FILTER (WHERE outcome = 'ok') AS ok, CAST(0 AS BIGINT) AS unchanged, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'error') AS error FROM told")
def crawl_stats_of_fetches(spark, d):
    return crawl.stats(_outcomes(spark, d).select(F.col("outcome").alias("status")))


@query(f"""WITH {_STATUS} SELECT url, CASE WHEN doc_id % 7 = 0 THEN reverse(hash) ELSE hash END AS hash, url || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.md' END AS file, 't' AS title, '2025-01-01' AS updated_at
FROM now WHERE doc_id % 3 <> 0""")
def state_json_values(spark, d):
    _, known, _ = _run_state(spark, d)
    back = state.from_json(state.to_json(known))
    return back.select("url", "hash", F.col("files")[0].alias("file"), "title", "updated_at")


@query(f"""WITH named AS (SELECT page_id, replace(replace({_slug(_title('html'), 100)} || '.chunk-' || CAST(page_id % 10 AS VARCHAR), '-', ' '), '.', ' ') AS name FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name FROM named""")
def display_names(spark, d):
    name = F.concat(T.slug(T.page_title("html"), 100), F.lit(".chunk-"), (F.col("page_id") % 10).cast("string"), F.lit(".md"))
    return _pages(spark, d).select("page_id", T.display_name(name).alias("name"))


_PLAIN_HTML = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<(nav|header|footer)\b[^>]*>.*?</(nav|header|footer)\s*>', '', 'g')"
#: Titles may be cut off behind a name, which is then without its semicolon.
_DECODED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"


@query(f"""WITH found AS (SELECT page_id, {_DECODED.format(_title('html'))} AS title, list_filter(regexp_extract_all({_PLAIN_HTML}, '(?is)<a\\s[^>]*?href="([^"]*)"', 1), lambda h: h <> '' AND (NOT regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(h, '(?i)^https?:'))) AS hrefs FROM pages)
SELECT page_id, title, {_DECODED.format("array_to_string(list_filter(hrefs, lambda h, i: list_position(hrefs, h) = i), ' ')")} AS hrefs FROM found""")
def html_title_links(spark, d):
    """Title and distinct links of every page by the HTML tree."""
    rows = _pages(spark, d).select("page_id", html.extract(F.col("html")).alias("x"))
    return rows.select("page_id", "x.title", F.array_join("x.hrefs", " ").alias("hrefs"))
