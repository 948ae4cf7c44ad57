"""Chunks of pages that are new or have changed, for whoever keeps a retrieval index up to date.

    python -m jobs.page_changes --pages /landing/pages --out /corpus/page-changes --checkpoint /corpus/page-changes.checkpoint

A file stream takes the page files (page_id, url, html) that have landed since the last run, and the run ends when
they are done. Pages meet under their canonical address; of several rows the one of greatest page_id counts, and rows
older than what was met before do not. A page whose title and visible text are those of its last version is left
alone; others are cut into chunks and appended below out, by bucket (first hex digit of the address's SHA-256), with
status new or changed. Who reads the output takes for each url the rows of its greatest page_id: see current().

What was taken, each page's last version and what was written are kept by Spark in the checkpoint and in out, so a run
that dies is taken up by the next, and a run without new files changes nothing. The number of shuffle partitions is
that of the first run. Pages without address, page_id or visible text are left out and counted.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from foliate.config import Config
from foliate.functions import text as T
from foliate.functions import urls as U
from foliate.operators import chunk
from foliate.streaming.changes import changes, keyed_state
from foliate.streaming.progress import counted
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common

log = logging.getLogger("jobs.page_changes")

PAGES = "page_id bigint, url string, html string"
OUT = "url string, page_id bigint, status string, title string, hash string, chunk_index bigint, chunk_total bigint, section string, content string, bucket string"


@dataclass(frozen=True)
class Settings:
    max_words: int = 200
    overlap_words: int = 20
    files_per_batch: int = 1000


def _pattern(path: str) -> str:
    """A path as a pattern that matches it alone: a stream takes single files by patterns only, folders by both."""
    return path if re.search(r"[*?\[{]", path) else re.sub(r"([^/])/*$", r"[\1]", path)


def profiled(pages: DataFrame) -> DataFrame:
    """url (canonical), page_id, title, text and hash of raw pages that have them."""
    # a row of its own, of which there is one: the optimizer would work out a column that is filtered on twice
    rows = pages.select("page_id", "url", "html", F.explode_outer(F.array(T.visible_text("html"))).alias("text"))
    rows = rows.select("page_id", U.canonical(F.col("url")).alias("url"), T.page_title("html").alias("title"), "text")
    rows = rows.where("page_id is not null and url is not null and coalesce(text, '') <> ''")
    return rows.select("url", "page_id", "title", "text", T.content_hash(F.concat_ws("\n", "title", "text")).alias("hash"))


def chunked(pages: DataFrame, s: Settings) -> DataFrame:
    config = Config(max_chunk_words=s.max_words, chunk_overlap_words=s.overlap_words)
    rows = chunk.chunk_rows(pages, config, body="text").withColumn("bucket", F.left(F.sha2("url", 256), F.lit(1)))
    return rows.select(*(x.split()[0] for x in OUT.split(", ")))


def run(spark: SparkSession, pages: str, out: str, checkpoint: str, s: Settings = Settings()) -> dict[str, int]:
    """Takes what has landed since the last run; the counters of this one."""
    raw = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", s.files_per_batch).parquet(_pattern(pages))
    raw = raw.observe("read", F.count("*").alias("pages"))
    good = profiled(raw).observe("used", F.count("*").alias("pages"))
    fresh = changes(good, "url", "page_id", "hash").observe("found", F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "changed").alias("changed"))
    rows = chunked(fresh, s).observe("written", F.count("*").alias("chunks"))
    name = f"page_changes {out}"
    with keyed_state(spark), counted(spark, name) as counters:
        query = rows.writeStream.queryName(name).format("parquet").partitionBy("bucket").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        t = counters.wait(query).totals
    total = {
        "read": t["read", "pages"], "left_out": t["read", "pages"] - t["used", "pages"], "new": t["found", "new"], "changed": t["found", "changed"],
        "chunks": t["written", "chunks"], "batches": counters.batches,
    }
    log.info("read %(read)d pages of %%s in %(batches)d batches, left out %(left_out)d; new %(new)d, changed %(changed)d; wrote %(chunks)d chunks to %%s" % total, pages, out)
    return total


def output(spark: SparkSession, out: str) -> DataFrame:
    """All that was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # nothing has landed yet
        return spark.createDataFrame([], OUT)
    return spark.read.schema(OUT).parquet(out)


def current(rows: DataFrame) -> DataFrame:
    """The chunks of each page's last version."""
    last = rows.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return rows.join(last, ["url", "page_id"], "left_semi")


def main(argv: list[str] | None = None) -> None:
    a = common.command_line(__doc__.split("\n")[0], {"pages": "folder, file or pattern of Parquet pages", "out": "folder of chunks", "checkpoint": "folder of the stream's own"}, argv)
    s = common.settings(Settings, a.config, "page_changes.json")
    spark = common.started("page_changes")
    try:
        run(spark, a.pages, a.out, a.checkpoint, s)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
