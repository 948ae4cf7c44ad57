"""The jobs as queries: each runs twice into one new folder, and what is there then comes back."""

from __future__ import annotations

import uuid

from foliate.plans import queries as q
from foliate.storage import shared_dir
from pyspark.sql import DataFrame, SparkSession

from jobs import common, corpus_chunks, page_changes

_PAGE = common.settings(page_changes.Settings, None, "page_changes.json")
_TEXT = common.settings(corpus_chunks.Settings, None, "corpus_chunks.json")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "job1")
    for _ in range(2):
        page_changes.run(spark, f"{sf_dir}/pages.parquet", f"{base}/out", f"{base}/checkpoint", _PAGE)
    return page_changes.output(spark, f"{base}/out")


def job2_corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "job2")
    for _ in range(2):
        corpus_chunks.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/report", _TEXT)
    return corpus_chunks.output(spark, f"{base}/out")


_TITLE, _VISIBLE = q._title("html"), q._visible("html")

QUERIES = {"job1_page_changes": job1_page_changes, "job2_corpus_chunks": job2_corpus_chunks}
ORACLES = {
    "job1_page_changes": f"""WITH RECURSIVE
page AS (SELECT page_id, {q._canonical('url')} AS url, {_TITLE} AS title, {_VISIBLE} AS text FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
hashed AS (SELECT *, {q._hash("title || chr(10) || text")} AS hash FROM page WHERE text <> ''),
last AS MATERIALIZED (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC, hash DESC) = 1),
{q.chunk_sql("SELECT url AS doc_id, text AS body FROM last", _PAGE.max_words, _PAGE.overlap_words)}
SELECT url, page_id, 'new' AS status, title, hash, chunk_index, chunk_total, section, content, left(sha256(url), 1) AS bucket FROM last JOIN chunked ON url = doc_id""",
    "job2_corpus_chunks": f"""WITH RECURSIVE
clean AS (SELECT doc_id, lang, source, {q._noise('text')} AS text FROM documents),
hashed AS MATERIALIZED (SELECT *, {q._hash('text')} AS hash FROM clean WHERE text <> ''),
kept AS MATERIALIZED (SELECT * FROM hashed QUALIFY count(*) OVER (PARTITION BY hash) = 1 OR doc_id = min(doc_id) OVER (PARTITION BY hash)),
{q.chunk_sql("SELECT doc_id, text AS body FROM kept", _TEXT.max_words, _TEXT.overlap_words)}
SELECT doc_id, hash, chunk_index, chunk_total, section, content, {q._count('content')} AS n_words, lang, source FROM kept JOIN chunked USING (doc_id)""",
}
