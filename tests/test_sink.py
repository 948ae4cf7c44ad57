"""Files under exact names: all of them or none."""

import glob
import os

import pytest
from foliate.sources import files, sink
from pyspark.sql import functions as F


def found(folder):
    return {os.path.relpath(p, folder): open(p, "rb").read() for p in glob.glob(f"{folder}/**", recursive=True, include_hidden=True) if os.path.isfile(p)}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_writes_replaces_and_removes(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}/out"
    rows = spark.createDataFrame([("a/x.md", "é\n"), ("b c/y+z.md", ""), ("top.md", None)], "path string, payload string").repartition(3)
    files.write(rows, folder)
    assert found(tmp_path / "out") == {"a/x.md": "é\n".encode(), "b c/y+z.md": b"", "top.md": b""}
    files.write(spark.createDataFrame([("a/x.md", bytearray(b"%PDF\x00\xff"))], "path string, payload binary"), folder)
    assert found(tmp_path / "out")["a/x.md"] == b"%PDF\x00\xff"
    files.remove(spark.createDataFrame([("a/x.md",), ("a/none.md",), ("a/x.md",)], "path string"), folder)
    assert set(found(tmp_path / "out")) == {"b c/y+z.md", "top.md"}
    files.write(rows.limit(0), folder)
    assert [p for p in os.listdir(tmp_path / "out") if p.startswith(".")] == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.write(spark.createDataFrame([("old.md", "old")], "path string, payload string"), folder)
    rows = spark.range(0, 40, 1, 4).select(F.format_string("n%02d.md", "id").alias("path"), F.when(F.col("id") == 35, F.raise_error(F.lit("no"))).otherwise("text").alias("payload"))
    with pytest.raises(Exception, match="no"):
        files.write(rows, folder)
    assert found(folder) == {"old.md": b"old"}


def test_names_stay_below_the_folder(spark, tmp_path):
    with pytest.raises(Exception, match="not below"):
        files.write(spark.createDataFrame([("../evil.md", "x")], "path string, payload string"), str(tmp_path / "out"))
    assert found(tmp_path) == {}
    with pytest.raises(ValueError):
        sink.below("/a/b", "/etc/passwd")
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a", b"")], "path string, payload binary").write.format(sink.FORMAT).mode("overwrite").save(str(tmp_path / "out"))


def test_the_attempts_that_count_are_moved_and_others_go(tmp_path):
    import pyarrow as pa

    writer = sink._Writer(str(tmp_path))
    batch = lambda text: iter([pa.RecordBatch.from_pydict({"path": ["d/a.md"], "payload": [text]})])
    writer.write(batch(b"lost attempt"))
    good = writer.write(batch(b"good"))
    assert set(os.listdir(tmp_path)) == {writer.hidden}
    writer.commit([None, good])
    assert found(tmp_path) == {"d/a.md": b"good"}
    writer = sink._Writer(str(tmp_path))
    writer.abort([writer.write(batch(b"never"))])
    assert found(tmp_path) == {"d/a.md": b"good"}
