import re

from foliate.config import Config
from foliate.operators import chunk
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


def rows(spark, body, most=10, overlap=3):
    df = spark.createDataFrame([("u", body)], "url string, body string")
    out = chunk.chunk_rows(df, Config(max_chunk_words=most, chunk_overlap_words=overlap)).collect()
    assert [r.chunk_index for r in out] == list(range(1, len(out) + 1)) and {r.chunk_total for r in out} == {len(out)}
    return [(r.section, r.content) for r in out]


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_short_or_single_pages_stay_whole(spark):
    assert rows(spark, words(10)) == [(None, words(10))]
    assert rows(spark, "## A\n" + words(8)) == [(None, "## A\n" + words(8))]
    assert rows(spark, None) == [(None, "")] and rows(spark, "") == [(None, "")]
    assert rows(spark, "# a\n# b\n# c\n# d\n# e\n# f\n") == [(None, "# a\n# b\n# c\n# d\n# e\n# f\n")]


def test_sections_merge_while_they_fit(spark):
    body = f"{words(3)}\n## A\n{words(4)}\n### B\n{words(4)}\n##### C\n{words(2)}"
    assert rows(spark, body) == [("Introdução", f"{words(3)}\n\n{words(4)}"), ("B", f"{words(4)}\n##### C\n{words(2)}")]


def test_a_long_section_becomes_windows(spark):
    body = f"## A\n{words(2)}\n## Long\n{words(24)}\n## Z\n{words(1)}"
    want = [("A", words(2)), ("Long", words(10)), ("Long (parte 2)", words(10, 7)), ("Long (parte 3)", words(10, 14)), ("Long (parte 4)", words(3, 21)), ("Z", words(1))]
    assert rows(spark, body) == want
    assert [c for _, c in rows(spark, words(20), 10, 0)] == [words(10), words(10, 10)]
    # the last window may lie inside the overlap
    assert [len(c.split()) for _, c in rows(spark, words(2900), 1500, 100)] == [1500, 1500, 100]


def test_headings_as_written(spark):
    body = "##\nnext line\n" + words(6) + "\n#####\tno\n# last  \n" + words(6)
    got = rows(spark, body)
    assert [s for s, _ in got] == ["next line", "last"]


BODY = st.lists(st.one_of(st.just("\n"), st.just("## h\n"), st.just("# \n"), st.integers(1, 30).map(words).map(lambda x: x + "\n")), max_size=12).map("".join)


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(BODY)
def test_no_chunk_is_too_long_and_no_word_is_lost(spark, body):
    got = rows(spark, body)
    if len(got) > 1:
        assert all(len(c.split()) <= 10 for _, c in got)
        kept = set(" ".join(c for _, c in got).split())
        # a heading takes the next line where nothing else follows its marks, and headings are not content
        content = re.sub(r"(?m)^(#{1,4})\s+(.+)$", "", body)
        assert set(re.findall(r"w\d+", content)) <= kept


def test_a_bare_mark_takes_the_next_line_as_its_heading(spark):
    body = f"# \n{words(12)}\n{words(11)}\n"
    assert rows(spark, body) == [(words(12), words(10)), (f"{words(12)} (parte 2)", words(4, 7))]


def test_time_is_in_proportion_to_the_sections(spark):
    """20,000 sections, and one word of each kind of white space between words."""
    import time

    from pyspark.sql import functions as F

    body = "".join(f"## h{i}\na\tb\x0bc\fd\r e\n" for i in range(20_000))
    df = spark.createDataFrame([("u", body)], "url string, body string")
    config = Config(max_chunk_words=10, chunk_overlap_words=3)
    chunk.chunk_rows(df, config).count()
    began = time.time()
    got = chunk.chunk_rows(df, config).agg(F.count("*").alias("n"), F.max("chunk_total").alias("total"), F.min(F.length("content")).alias("least")).first()
    assert time.time() - began < 5 and (got.n, got.total, got.least) == (10_000, 10_000, 22)
    ids = df.select(chunk.fold(F.transform(chunk.sections(F.col("body")), lambda s: s["n"]), 10).alias("ids")).first().ids
    assert ids == [i // 2 + 1 for i in range(20_000)]


def test_fold_of_nothing(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([],), (None,), ([11, 1, 0, 9, 1],)], "n array<bigint>")
    assert [r.ids for r in rows.select(chunk.fold(F.col("n"), 10).alias("ids")).collect()] == [[], None, [1, 2, 2, 2, 3]]
