"""Pages that land in a folder, extracted, classified against the state and chunked, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import storage
from ..config import Config
from ..functions import text as T
from ..operators import chunk
from ..operators.state import Store
from ..sources import pages as P

SCHEMA = "url string, html string, fetched_at timestamp"


def batch(raw: DataFrame, store: Store, out: str, config: Config, number: int) -> None:
    """Chunks of new and changed pages are appended below out; the state moves on. A batch that is run again
    after a failure overwrites its own output: what it has put into the state itself counts as not seen."""
    spark = raw.sparkSession
    latest = raw.groupBy("url").agg(F.max_by("html", "fetched_at").alias("html"), F.max("fetched_at").alias("at"))
    rows = P.store(latest, config).join(latest.groupBy(_canonical("url").alias("url")).agg(F.max("at").alias("at")), "url")
    rows = rows.where(F.coalesce("markdown", F.lit("")) != "")
    rows = rows.withColumn("hash", T.content_hash(F.concat_ws("\n", "title", "url", "markdown")))
    path = f"{out}/batch={number}"
    state = store.load()
    seen = state.where(~F.array_contains("files", path)).select("url", "hash")
    fresh = storage.save(rows.join(seen, ["url", "hash"], "left_anti"), "fresh")
    chunk.chunk_rows(fresh.withColumnRenamed("markdown", "body"), config).select(
        "url", "title", "hash", "chunk_index", "chunk_total", "section", "content"
    ).write.mode("overwrite").parquet(path)
    done = fresh.select("url", "hash", F.array(F.lit(path)).alias("files"), "title", T.iso_time(F.col("at")).alias("updated_at"))
    if spark.read.parquet(path).head(1):
        store.put(done)


def _canonical(name: str):
    from ..functions.urls import canonical

    return canonical(F.col(name))


def start(spark: SparkSession, landing: str, state: str, out: str, checkpoint: str, config: Config = Config(), once: bool = False) -> StreamingQuery:
    """A query over Parquet files that land in a folder. once: take what is there and stop."""
    store = Store(spark, state)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 100).parquet(landing)
    writer = stream.writeStream.foreachBatch(lambda df, n: batch(df, store, out, config, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
