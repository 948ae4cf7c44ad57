"""Command line: crawl a page store (or the web) into files, or consolidate files that are there.

    python -m foliate.cli --pages store.parquet --docs-file seeds.txt --out output --format md --chunk
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .config import FORMATS, Config
from .functions import text as T
from .operators import chunk, consolidate, crawl, render, state
from .sources import files, http, pages, seeds

log = logging.getLogger("foliate")

#: Causes of failures that the log lists, the most frequent first.
CAUSES = 20
#: Files that _index.md lists; of more there is an index in parts, _index.part-00000.md and so on.
INDEX_FILES = 50_000


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    d = Config()
    p = argparse.ArgumentParser(prog="foliate", description=__doc__.split("\n")[0])
    p.add_argument("--depth", type=int, default=d.max_depth, help="levels to follow; 1 is the roots alone")
    p.add_argument("--workers", type=int, default=d.max_workers, help="partitions that fetch over HTTP")
    p.add_argument("--chunk", action="store_true", help="split long pages into chunks")
    p.add_argument("--format", choices=FORMATS, default=d.output_format)
    p.add_argument("--flat", action="store_true", help="no folders by root")
    p.add_argument("--force", action="store_true", help="write every page again and forget those that are gone")
    p.add_argument("--urls", nargs="+", help="roots, in place of a seed file")
    p.add_argument("--docs-file", help="seed file")
    p.add_argument("--consolidate", action="store_true", help="also write one document of all pages")
    p.add_argument("--consolidate-only", action="store_true", help="no crawl, one document of the files that are there")
    p.add_argument("--pages", help="Parquet of url and html; without it pages are fetched over HTTP")
    p.add_argument("--api-base", default=d.api_base, help="REST API of pages, asked before HTML where a url has a page id")
    p.add_argument("--out", default=d.output_dir)
    p.add_argument("--max-words", type=int, default=d.max_chunk_words)
    p.add_argument("--overlap-words", type=int, default=d.chunk_overlap_words)
    return p.parse_args(argv)


def run(spark: SparkSession, config: Config, lines: DataFrame, raw: DataFrame | None, now: str, force: bool = False) -> dict[str, int]:
    """Crawls, writes files, state and index; returns the counters."""
    out = os.path.abspath(config.output_dir)
    os.makedirs(out, exist_ok=True)
    allowed, preferred = seeds.scope(lines)
    roots = seeds.roots(lines, allowed, preferred)
    table = None
    if raw is None:
        fetch = lambda frontier: _joined(frontier, pages.store(http.fetch(frontier.select("url"), config), config, allowed, preferred))
        found = crawl.crawl(roots, fetch, config.max_depth, pages.follow(config, allowed))
    else:
        table = storage.save(pages.store(raw, config, allowed, preferred), "pages")
        found = crawl.crawl_store(roots, table, config.max_depth, pages.follow(config, allowed))
    found = found.withColumn("fetched", crawl.status()).withColumns({"scraped_at": F.lit(now), "body": F.col("markdown")})
    found = storage.save(found.withColumn("hash", T.content_hash(render.md())), "found")
    for cause in found.where("fetched = 'error'").groupBy("error").agg(F.count("*").alias("n"), F.min("url").alias("url")).orderBy(F.desc("n"), "error").limit(CAUSES).collect():
        log.warning("%d pages failed with %s, such as %s", cause.n, cause.error, cause.url)
    store = state.Store(spark, f"{out}/.state")
    extension = T.extension(config.output_format)
    there = files.listing(spark, out, f"*{extension}")
    known = store.load()
    gone = storage.save(pages.gone(found, known, table) if force else known.select("url").where("false"), "gone")
    judged = state.classify(found.where("fetched = 'ok'"), known, there, extension, force or not config.incremental)
    judged = storage.save(judged, "judged")
    todo = judged.where("status <> 'unchanged'")
    if config.chunk_pages:
        rows = chunk.chunk_rows(todo, config)
        rows = rows.withColumn("chunk", F.when(F.col("chunk_total") > 1, F.concat_ws("/", "chunk_index", "chunk_total"))).withColumn("body", F.col("content"))
    else:
        rows = todo
    if config.output_format == "csv":
        lines = render.csv_rows(rows, render.plain_text())
        if os.path.isdir(f"{out}/_pages.csv"):  # changed pages replace their rows, those that are gone lose them
            over = todo.select("url").union(gone).select(F.col("url").alias("source_url"))
            earlier = files.read_csv(spark, f"{out}/_pages.csv").join(over, "source_url", "left_anti")
            lines = earlier.select(*render.CSV_FIELDS).unionByName(lines)
        files.write_csv(storage.save(lines, "csv"), f"{out}/_pages.csv", append=False)
        written = todo.select("url", F.lit("_pages.csv").alias("path"))
    else:
        taken = known.select("url", F.explode("files").alias("path"))
        named = files.distinct_paths(rows.withColumn("path", files.paths(config.chunk_pages, config.output_format, config.flat_output)), taken)
        named = storage.save(named.withColumn("payload", render.convert(config.output_format, config.chunk_pages)), "files")
        files.write(named, out)
        written = named.select("url", "path")
    by_url = written.groupBy("url").agg(F.sort_array(F.collect_set("path")).alias("files"))
    fresh = todo.join(by_url, "url").select("url", "hash", "files", "title", F.lit(now).alias("updated_at"))
    following = storage.save(state.upsert(known, fresh).join(gone, "url", "left_anti"), "state")
    # names that pages no longer have, in this format, and all that pages that are gone have left
    left = known.select("url", F.explode("files").alias("path")).join(state.all_files(following), "path", "left_anti")
    left = left.join(gone.withColumn("_gone", F.lit(True)), "url", "left").where(F.col("path").endswith(extension) | F.col("_gone"))
    files.remove(left.where(F.col("path") != "_pages.csv"), out)
    store.put(fresh, gone)
    status = judged.select("status").union(found.where("fetched <> 'ok'").select("fetched"))
    counters = storage.save(crawl.stats(status), "stats")
    current = state.all_files(following.join(judged.select("url"), "url", "left_semi")).distinct()
    if config.output_format != "csv":
        if current.count() <= INDEX_FILES:
            listed = consolidate.index(current, counters).select(F.lit("_index.md").alias("path"), F.col("content").alias("payload"))
        else:
            listed = consolidate.index_parts(current, counters).select(F.format_string("_index.part-%05d.md", "part").alias("path"), F.col("content").alias("payload"))
        files.write(listed, out)
        if config.consolidate:
            together(spark, out, config.output_format, current)
    return counters.first().asDict()


def _joined(frontier: DataFrame, fetched: DataFrame) -> DataFrame:
    return frontier.join(fetched, "url", "left")


def together(spark: SparkSession, out: str, fmt: str, listed: DataFrame | None = None) -> str | None:
    """One document of all listed files, or of those below out; its path, or None if there is nothing to do."""
    if fmt == "csv":
        log.info("CSV is one table already")
        return None
    extension = T.extension(fmt)
    found = consolidate.candidates(listed, extension) if listed is not None else None
    if found is None or not found.head(1):
        found = consolidate.candidates(files.listing(spark, out, f"*{extension}"), extension)
    if not found.head(1):
        log.warning("no %s files below %s", extension, out)
        return None
    if fmt == "pdf":
        texts = consolidate.companions(found, files.read(spark, out, "*.md"))
    else:
        texts = files.read(spark, out, f"*{extension}").join(found, "path", "left_semi")
    document = consolidate.consolidate(render.parse(texts), fmt)
    files.write(document.select(F.lit(f"_all{extension}").alias("path"), F.col("content").alias("payload")), out)
    return f"{out}/_all{extension}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    os.makedirs(a.out, exist_ok=True)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=[logging.StreamHandler(), logging.FileHandler(f"{a.out}/run.log")])
    spark = spark or SparkSession.builder.appName("foliate").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.consolidate_only:
        together(spark, os.path.abspath(a.out), a.format)
        return 0
    config = Config(
        max_depth=a.depth, max_workers=a.workers, chunk_pages=a.chunk, output_format=a.format, flat_output=a.flat, incremental=not a.force,
        consolidate=a.consolidate, output_dir=a.out, max_chunk_words=a.max_words, chunk_overlap_words=a.overlap_words,
        api_base=a.api_base,
    )
    if a.urls:
        lines = seeds.from_urls(spark, a.urls)
    elif a.docs_file and os.path.exists(a.docs_file):
        lines = seeds.lines(spark, a.docs_file)
    else:
        log.error("no seed file and no --urls")
        return 1
    if not seeds.entries(lines).head(1):
        log.error("no roots")
        return 1
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    counters = run(spark, config, lines, spark.read.parquet(a.pages) if a.pages else None, now, a.force)
    log.info("%s", counters)
    return 0


if __name__ == "__main__":
    sys.exit(main())
