"""Incremental runs: what is new, changed or unchanged, and the state's next snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, hash string, files array<string>, title string, updated_at string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Changes after which a state is written anew.
COMPACT = 10


def classify(pages: DataFrame, state: DataFrame, files: DataFrame, extension: str, force: bool = False) -> DataFrame:
    """pages (url, hash, ...) with status: new, changed or unchanged.

    Unchanged means: the state has the url with an equal hash, all its files exist (files: path) and have the extension.
    """
    known = state.select("url", F.col("hash").alias("_hash"), F.col("files").alias("_files"))
    there = known.select("url", F.explode("_files").alias("path")).join(files.select("path").distinct(), "path", "left_semi")
    there = there.groupBy("url").agg(F.count("*").alias("_there"))
    rows = pages.join(known, "url", "left").join(there, "url", "left")
    fits = (F.size("_files") > 0) & (F.coalesce("_there", F.lit(0)) == F.size("_files")) & F.forall("_files", lambda f: f.endswith(extension))
    same = F.coalesce((F.col("hash") == F.col("_hash")) & fits, F.lit(False)) & ~F.lit(force)
    status = F.when(F.col("_hash").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return rows.withColumn("status", status).drop("_hash", "_files", "_there")


def upsert(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The state with the entries of fresh in place of older ones."""
    return state.join(fresh.select("url"), "url", "left_anti").unionByName(fresh.select(*state.columns))


def tombstones(state: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries whose url this run did not meet."""
    return state.join(seen.select("url"), "url", "left_anti")


def tracked(state: DataFrame) -> int:
    return state.count()


def all_files(state: DataFrame) -> DataFrame:
    return state.select(F.explode("files").alias("path")).where("path <> ''")


class Store:
    """State as snapshots and the changes since: folders v<n> and d<n> of Parquet below a path, n rising over both.

    What counts is the last whole snapshot and, for each url, the last of the whole changes after it. put() writes what has
    changed alone; after COMPACT of them the state is written anew as a snapshot, and what lies before the snapshot
    before that is deleted. A folder counts once its _SUCCESS is there, which the writer adds last, so a run that dies
    leaves the last state; the next one writes over what it left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str = "") -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self, kind: str = "v") -> list[int]:
        fs, root = self._path()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == kind and n[1:].isdigit() and fs.exists(self._path(f"{n}/_SUCCESS")[1]))

    def _last(self) -> tuple[int, list[int]]:
        """Number of the snapshot that counts, 0 for none, and those of the changes after it."""
        base = max(self._versions(), default=0)
        return base, [n for n in self._versions("d") if n > base]

    def load(self) -> DataFrame:
        """The state as it stands; empty if there is none."""
        base, after = self._last()
        state = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{base}") if base else self.spark.createDataFrame([], SCHEMA)
        if not after:
            return state
        rows = state.withColumn("gone", F.lit(False)).withColumn("n", F.lit(base))
        for n in after:
            rows = rows.unionByName(self.spark.read.schema(f"{SCHEMA}, gone boolean").parquet(f"{self.path}/d{n}").withColumn("n", F.lit(n)))
        last = rows.groupBy("url").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("url", "n")]), "n").alias("s"))
        return last.select("url", "s.*").where("not gone").select(state.columns)

    def put(self, fresh: DataFrame, gone: DataFrame | None = None) -> None:
        """Entries of fresh in place of older ones, and without the urls of gone."""
        base, after = self._last()
        rows = fresh.select(*COLUMNS).withColumn("gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select("url").join(fresh.select("url"), "url", "left_anti").withColumn("gone", F.lit(True)), allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.path}/d{max([base, *after]) + 1}")
        if len(after) + 1 >= COMPACT:
            self.save(self.load())

    def save(self, state: DataFrame) -> None:
        """The whole state as a snapshot. What lies before the last snapshot, which others may still read, goes."""
        base, after = self._last()
        state.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/v{max([base, *after]) + 1}")
        for kind in "vd":
            for n in self._versions(kind):
                if n < base:
                    fs, at = self._path(f"{kind}{n}")
                    fs.delete(at, True)


def from_json(text: DataFrame) -> DataFrame:
    """State entries of a JSON map url -> {hash, file, title, updated_at} (column value); nothing if it cannot be read."""
    kind = "map<string,struct<hash:string,file:string,title:string,updated_at:string>>"
    entries = text.select(F.explode(F.from_json("value", kind)).alias("url", "e"))
    files = F.when(F.coalesce("e.file", F.lit("")) != "", F.array("e.file")).otherwise(F.array().cast("array<string>"))
    return entries.select("url", "e.hash", files.alias("files"), "e.title", "e.updated_at")


def to_json(state: DataFrame) -> DataFrame:
    """One JSON object per entry (column value), in order of url; the first file stands for all."""
    entry = F.struct("hash", F.coalesce(F.try_element_at("files", F.lit(1)), F.lit("")).alias("file"), "title", "updated_at")
    return state.orderBy("url").select(F.to_json(F.map_from_arrays(F.array("url"), F.array(entry))).alias("value"))


def export_json(state: DataFrame, path: str) -> None:
    """The whole map as one indented JSON file. For small states: rows stream through the driver, none is kept but the text line."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for i, row in enumerate(to_json(state).toLocalIterator()):
            (url, entry), = json.loads(row.value).items()
            body = json.dumps(entry, ensure_ascii=False, indent=2).replace("\n", "\n  ")
            out.write(("," if i else "") + f"\n  {json.dumps(url, ensure_ascii=False)}: {body}")
        out.write("\n}\n")
