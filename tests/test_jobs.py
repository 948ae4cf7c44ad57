import glob
import json
import os
import shutil
import subprocess
import sys

import pytest
from foliate.streaming import changes as C
from jobs import common, corpus_chunks, page_changes
from jobs import queries as Q
from pyspark.sql import Row
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def page(title, text):
    return f"<html><head><title>{title}</title></head><body><p>{text}</p></body></html>"


def land(spark, folder, rows):
    spark.createDataFrame([(*r, "x") for r in rows], page_changes.PAGES + ", hash string").coalesce(1).write.mode("append").parquet(folder)


def told(rows):
    return sorted((r.url, r.page_id, r.status, r.chunk_index, r.chunk_total, r.section, r.content) for r in rows.collect())


def test_page_changes_over_growing_input(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    s = page_changes.Settings(max_words=4, overlap_words=1)
    before = {k: spark.conf.get(k, None) for k in C._STORE}
    first = [
        (1, "http://H.example/a/", page("A", "one two three")), (2, "https://h.example/b", page("B", "one two three four five six")), (3, "https://h.example/b#x", page("B", "newest of b")),
        (4, "https://h.example/empty", "<p> </p>"), (5, "https://h.example/null", None), (6, None, page("N", "n")), (None, "https://h.example/a", page("A", "no number")),
        (7, "https://h.example/c", page("C", "same")), (7, "https://h.example/c", page("C", "same")),
    ]
    land(spark, landing, first + [(i, "https://hot.example/", page("Hot", f"version {i}")) for i in range(100, 400)])
    got = page_changes.run(spark, landing, out, checkpoint, s)
    assert got == {"read": 309, "left_out": 4, "new": 4, "changed": 0, "chunks": 4, "batches": 1}
    assert told(page_changes.output(spark, out)) == [
        ("https://h.example/a", 1, "new", 1, 1, None, "one two three"), ("https://h.example/b", 3, "new", 1, 1, None, "newest of b"),
        ("https://h.example/c", 7, "new", 1, 1, None, "same"), ("https://hot.example", 399, "new", 1, 1, None, "version 399"),
    ]
    # nothing new: nothing changes
    files = sorted(glob.glob(f"{out}/**/*.parquet", recursive=True))
    assert page_changes.run(spark, landing, out, checkpoint, s)["read"] == 0
    assert sorted(glob.glob(f"{out}/**/*.parquet", recursive=True)) == files
    # unchanged, changed, older than what is known, and new; only the new file is read
    land(spark, landing, [
        (11, "https://h.example/a", page("A", "one two three")), (12, "https://h.example/b", page("B", "one two three four five six")), (5, "https://h.example/c", page("C", "too old")), (13, "https://h.example/d", page("D", "d")),
    ])
    got = page_changes.run(spark, landing, out, checkpoint, s)
    assert (got["read"], got["new"], got["changed"]) == (4, 1, 1)
    rows = page_changes.output(spark, out)
    assert [r[1:] for r in told(rows) if r[0].endswith("/b") and r[1] == 12] == [(12, "changed", 1, 2, "Introdução", "one two three four"), (12, "changed", 2, 2, "Introdução (parte 2)", "four five six")]
    # a is known as of page 11 though it was not written: page 10 is older
    land(spark, landing, [(10, "https://h.example/a", page("A", "between"))])
    assert page_changes.run(spark, landing, out, checkpoint, s)["chunks"] == 0
    assert {(r.url, r.page_id) for r in page_changes.current(page_changes.output(spark, out)).collect()} == {
        ("https://h.example/a", 1), ("https://h.example/b", 12), ("https://h.example/c", 7), ("https://h.example/d", 13), ("https://hot.example", 399),
    }
    assert {k: spark.conf.get(k, None) for k in C._STORE} == before


def test_many_small_batches_end_as_one_does(spark, tmp_path):
    """Copies of the given pages, landing in five files, later ones with new versions of some."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    again = given.where("page_id % 7 = 0").withColumn("page_id", F.col("page_id") + 10_000).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<p>more</p>"))).otherwise(F.col("html")))
    rows = given.unionByName(again)
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    for k in range(5):
        rows.where((F.col("page_id") < 10_000) & (F.col("page_id") % 5 == k) if k < 4 else (F.col("page_id") >= 10_000) | (F.col("page_id") % 5 == 4)).coalesce(1).write.mode("append").parquet(many)
    rows.coalesce(1).write.parquet(one)
    s = page_changes.Settings(max_words=50, overlap_words=5, files_per_batch=1)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")  # the counters are of all batches all the same
    try:
        counts = page_changes.run(spark, many, str(tmp_path / "out-many"), str(tmp_path / "check-many"), s)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert counts["read"] == rows.count() and counts["chunks"] == page_changes.output(spark, str(tmp_path / "out-many")).count()
    page_changes.run(spark, one, str(tmp_path / "out-one"), str(tmp_path / "check-one"), s)
    assert counts["batches"] == 5 and counts["changed"] > 0
    a, b = (page_changes.current(page_changes.output(spark, str(tmp_path / n))) for n in ("out-many", "out-one"))
    strip = lambda rows: sorted((r.url, r.chunk_index, r.content) for r in rows.collect())
    assert strip(a) == strip(b)
    # what a batch writes to the state grows with its changes, not with the state
    logs = {}
    for path in glob.glob(f"{tmp_path}/check-many/state/**/*.changelog", recursive=True):
        n = int(os.path.basename(path).split("_")[0].split(".")[0])
        logs[n] = logs.get(n, 0) + os.path.getsize(path)
    assert len(logs) >= 5 and logs[max(logs)] < 2 * max(logs[n] for n in logs if n < max(logs))


def test_a_key_costs_no_more_than_its_state(spark):
    """One look and one change a key, one row held; most of the job's time at size went to a frame a key."""

    class Value:
        def __init__(self):
            self.value, self.calls = None, []

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return last

    last, step = Value(), C._Latest("url", "page_id", "hash")
    step.init(Handle())
    told = lambda rows: [r.asDict() for r in step.handleInputRows(("u",), iter(rows), None)]
    row = lambda version, digest: Row(url="u", page_id=version, hash=digest, text=f"t{version}")
    assert told(row(i % 1000, "a") for i in range(5000)) == [{"url": "u", "page_id": 999, "hash": "a", "text": "t999", "status": "new"}]
    assert last.calls == ["get", "update"]
    assert told([row(1000, "a")]) == [] and last.value == (1000, "a")
    assert told([row(1000, "a"), row(3, "z")]) == [] and last.value == (1000, "a")
    assert told([row(1000, "b"), row(1000, "a")]) == [{"url": "u", "page_id": 1000, "hash": "b", "text": "t1000", "status": "changed"}]
    assert told([]) == [] and last.value == (1000, "b")


def test_text_is_taken_out_of_a_page_once(spark):
    pages = spark.read.schema(page_changes.PAGES).parquet("/root/testdata/sf0.001/pages.parquet")
    plan = page_changes.profiled(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("</noscript") == 1


def test_no_page_has_landed(spark, tmp_path):
    os.makedirs(tmp_path / "landing")
    got = page_changes.run(spark, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert got["batches"] == 0
    assert page_changes.output(spark, str(tmp_path / "out")).count() == 0
    spark.createDataFrame([], page_changes.PAGES).write.parquet(str(tmp_path / "empty"))
    assert page_changes.run(spark, str(tmp_path / "empty"), str(tmp_path / "out2"), str(tmp_path / "checkpoint2"))["chunks"] == 0
    assert page_changes.output(spark, str(tmp_path / "out2")).count() == 0


DOCS = [
    (1, "# One\nLog in here\none two three", "en", "s1"), (2, "# One\n\none two three", "en", "s2"), (3, None, "en", "s1"), (4, " \n ", "de", "s1"), (5, "eins zwei drei vier fünf sechs", "de", None),
    (6, "# One\n\none two three", None, "s1"), (7, "## a\nx y\n## b\nz w\n## c\nu v", "en", "s1"), (None, "no id", "en", "s1"), (8, "no id", "en", "s1"),
]


def chunks(spark, out):
    return sorted(((r.lang, r.source, r.doc_id, r.chunk_index, r.chunk_total, r.section, r.content, r.n_words) for r in corpus_chunks.output(spark, out).collect()), key=str)


def test_corpus_chunks(spark, tmp_path):
    docs, out, report = (str(tmp_path / n) for n in ("docs", "out", "report"))
    spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id bigint, text string, lang string, source string, hash string").write.parquet(docs)
    s = corpus_chunks.Settings(max_words=4, overlap_words=1)
    assert corpus_chunks.run(spark, docs, out, report, s) == {"read": 9, "kept": 4, "chunks": 6}
    first = chunks(spark, out)
    assert first == sorted([
        ("de", None, 5, 1, 2, "Introdução", "eins zwei drei vier", 4), ("de", None, 5, 2, 2, "Introdução (parte 2)", "vier fünf sechs", 3),
        ("en", "s1", 1, 1, 1, None, "# One\n\none two three", 5), ("en", "s1", 7, 1, 2, "a", "x y\n\nz w", 4), ("en", "s1", 7, 2, 2, "c", "u v", 2), ("en", "s1", 8, 1, 1, None, "no id", 2),
    ], key=str)
    totals = spark.read.option("header", True).schema(corpus_chunks.REPORT).csv(report)
    assert sorted(map(tuple, totals.collect()), key=str) == sorted([("de", None, 1, 2, 7), ("en", "s1", 3, 4, 13)], key=str)
    assert corpus_chunks.run(spark, docs, out, report, s)["chunks"] == 6  # again: the same
    assert chunks(spark, out) == first
    # one language is done anew, the others stay
    spark.createDataFrame([(9, "neu", "de", "s9"), (5, "anders", "de", None), (10, "new", "en", "s1")], "doc_id bigint, text string, lang string, source string").write.mode("overwrite").parquet(docs)
    corpus_chunks.run(spark, docs, out, report, corpus_chunks.Settings(max_words=4, overlap_words=1, langs=("de",)))
    assert chunks(spark, out) == sorted([r for r in first if r[0] == "en"] + [("de", None, 5, 1, 1, None, "anders", 1), ("de", "s9", 9, 1, 1, None, "neu", 1)], key=str)
    # without languages nothing of earlier runs stays
    corpus_chunks.run(spark, docs, out, report, s)
    assert {r[2] for r in chunks(spark, out)} == {5, 9, 10}


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"langs": ["en"], "max_words": 7}))
    assert common.settings(corpus_chunks.Settings, str(path), "") == corpus_chunks.Settings(7, 40, ("en",))
    path.write_text('{"words": 1}')
    with pytest.raises(ValueError, match="words"):
        common.settings(corpus_chunks.Settings, str(path), "")


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "docs"))
    args = [sys.executable, "-m", "jobs.corpus_chunks", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--report", str(tmp_path / "report")]
    done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=240, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "kept 1, wrote 1 chunks" in done.stderr
    assert [r.content for r in corpus_chunks.output(spark, str(tmp_path / "out")).collect()] == ["a b c"]


def test_queries_leave_their_files_and_stand_alone(spark, tmp_path):
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    a = Q.job2_corpus_chunks(spark, str(tmp_path / "sf"))
    b = Q.job2_corpus_chunks(spark, str(tmp_path / "sf"))
    assert a.count() == b.count() > 0 and not set(a.inputFiles()) & set(b.inputFiles())
    for name in ("page_changes", "corpus_chunks", "queries", "common"):
        with open(os.path.join(ROOT, "jobs", f"{name}.py"), encoding="utf-8") as f:
            text = f.read()
        assert "llm" not in text and "corpus_pipeline" not in text
