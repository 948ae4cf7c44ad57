"""The operators as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, minhash, mixing, packing, periodic, pu, quality, suffixes, unigram, urls, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in urls.LISTED], "key string")
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), listed)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    chosen = mixing.taken(docs, F.array("source"))
    return chosen.select(
        "doc_id",
        F.col("mix.size").alias("size"),
        F.col("mix.plan.source_sizes")[0].alias("source_size"),
        F.col("mix.plan.targets")[0].alias("target"),
        (F.col("mix.size") * F.col("mix.copies")).cast("long").alias("taken"),
    )


def _fitted(spark: SparkSession, rows: DataFrame, sf_dir: str) -> pu.Model:
    """A model of the rows of pu.featured() and the positives that are not held out."""
    positives = _table(spark, sf_dir, "labels").where("quality = 1")
    return pu.fit_features(rows.where(~pu.held_out()), positives.where(~pu.held_out()))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> pu.Model:
    """Fitted on the rows that are not held out."""
    return _fitted(spark, pu.featured(docs.where(~pu.held_out())), sf_dir)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pu.featured(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pu.score_features(rows, _fitted(spark, rows, sf_dir)).select("doc_id", pu.held_out().alias("held_out"), "score", "predicted")


def op6_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Words of the contracts, as Java sees them.
WHITE = r"[ \t-\r]+"


def with_periods(text: Column, doc_id: Column) -> Column:
    """The text of one document in ten with its words from some place on repeated in a period, words joined by a space; others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")

    def repeated(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.periodic_runs(docs)
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda top, run: F.when(more(run, top), run).otherwise(top))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    rows = found.select("doc_id", "collapsed", "runs", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    rows = found.select("doc_id", "n_words", leaks.hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_mix_sources": op5_mix_sources,
    "op6_warc_index_merge": op6_warc_index_merge,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": minhash.ORACLE,
    "op4_url_filter": urls.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op6_warc_index_merge": warc.ORACLE,
    "op7_suffix_array_dedup": suffixes.ORACLE,
    "op10_embedding_near_dedup": vectors.ORACLE,
    "op12_benchmark_decontamination": leaks.ORACLE,
}
