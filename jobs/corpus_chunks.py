"""Documents as clean chunks by language and source, each text once, for indexing and for review.

    python -m jobs.corpus_chunks --documents /corpus/documents --out /corpus/chunks --report /corpus/chunks-report

Texts (doc_id, text, lang, source) lose the noise of converted pages, equal ones (by the hash of what is left) are kept
under the least doc_id alone, and the rest is cut into chunks at headings and by words. Chunks are Parquet below
out, by lang and source; report has documents, chunks and words of each, as CSV, and what was left out.

With langs in the settings only their partitions are replaced; without, all of out is. Either way a run over the same
documents leaves the same rows. Texts that are null or have nothing left are left out and counted. Copies are looked
for in the documents taken, so with langs, within those languages. A null doc_id is the greatest of all.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from foliate import storage
from foliate.config import Config
from foliate.functions import text as T
from foliate.operators import chunk
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common

log = logging.getLogger("jobs.corpus_chunks")

DOCUMENTS = ("doc_id", "text", "lang", "source")
OUT = "doc_id bigint, hash string, chunk_index bigint, chunk_total bigint, section string, content string, n_words bigint, lang string, source string"
REPORT = "lang string, source string, n_docs bigint, n_chunks bigint, n_words bigint"


@dataclass(frozen=True)
class Settings:
    max_words: int = 400
    overlap_words: int = 40
    langs: tuple[str, ...] = ()


def once(docs: DataFrame) -> DataFrame:
    """docs (doc_id, hash, ...) without those whose hash a lesser doc_id has. Only hashes that occur twice meet the documents."""
    shared = docs.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return docs.join(shared, "hash", "left").where("first is null or doc_id = first").drop("first")


def cleaned(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", "lang", "source", T.clean_noise(F.col("text")).alias("text")).where("coalesce(text, '') <> ''")
    return rows.withColumn("hash", T.content_hash(F.col("text")))


def run(spark: SparkSession, documents: str, out: str, report: str, s: Settings = Settings()) -> dict[str, int]:
    """Replaces out, or its partitions of the languages asked for, and the report; the counters."""
    wrote = Observation("wrote")
    docs = spark.read.parquet(documents).select(*DOCUMENTS)
    if s.langs:
        docs = docs.where(F.col("lang").isin(*s.langs))
    n_read = docs.count()
    config = Config(max_chunk_words=s.max_words, chunk_overlap_words=s.overlap_words)
    with storage.scratch(spark, "corpus-chunks") as save:
        good = save(cleaned(docs), "cleaned")
        rows = chunk.chunk_rows(once(good), config, body="text").withColumn("n_words", T.word_count(F.col("content")))
        rows = rows.select(*(x.split()[0] for x in OUT.split(", "))).observe(wrote, F.count("*").alias("chunks"), F.count_if(F.col("chunk_index") == 1).alias("docs"))
        # rows of a partition meet in a few tasks, a large one is split
        rows = rows.hint("rebalance", "lang", "source")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if s.langs else "static").partitionBy("lang", "source").parquet(out)
    totals = output(spark, out).groupBy("lang", "source").agg(F.count_if(F.col("chunk_index") == 1).alias("n_docs"), F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"))
    totals.repartitionByRange(1, "lang", "source").sortWithinPartitions("lang", "source").write.mode("overwrite").option("header", True).csv(report)
    done = {"read": n_read, "kept": wrote.get["docs"], "chunks": wrote.get["chunks"]}
    log.info("read %d documents of %s, kept %d, wrote %d chunks to %s", done["read"], documents, done["kept"], done["chunks"], out)
    return done


def output(spark: SparkSession, out: str) -> DataFrame:
    """All that was written."""
    return spark.read.schema(OUT).parquet(out)


def main(argv: list[str] | None = None) -> None:
    a = common.command_line(__doc__.split("\n")[0], {"documents": "Parquet of documents", "out": "folder of chunks", "report": "folder of totals"}, argv)
    s = common.settings(Settings, a.config, "corpus_chunks.json")
    spark = common.started("corpus_chunks")
    try:
        run(spark, a.documents, a.out, a.report, s)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
