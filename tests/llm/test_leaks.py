"""Occurrences of item windows against plain search."""

import hashlib
import re

import duckdb
import pytest
from foliate.llm import leaks, queries
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    """(n_words, n_hit, sorted ids)."""
    words, hit, ids = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        m = min(window, len(own))
        for s in range(len(own) - m + 1) if own else ():
            for t in range(len(words) - m + 1):
                if words[t : t + m] == own[s : s + m]:
                    hit.update(range(t, t + m))
                    ids.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(ids)


def by_blocks(texts, items, window=10):
    import pyarrow as pa

    kept = [(("" if i is None else str(i)), t) for i, t in items if t is not None]
    table = leaks.Items([i for i, _ in kept], pa.array([t for _, t in kept], pa.string()), window)
    out = []
    for _, _, data, offsets in leaks.blocks(pa.array(texts, pa.string())):
        words = leaks.read_words(data, offsets)
        hit, found = table.find(words)
        spans = leaks._spans(hit, words).to_pylist()
        out += [(int(words.counts[d]), sum(s["end"] - s["start"] for s in spans[d]), found.get(d, [])) for d in range(words.n_docs)]
    return out


letters = st.sampled_from(["a", "b", "A", "é", "7"])
line = st.lists(letters, max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(line, min_size=1, max_size=4), st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), line)), max_size=5), st.sampled_from([1, 2, 3, 10]))
def test_blocks_against_plain_search(texts, items, window):
    assert by_blocks(texts, items, window) == [brute(t, items, window) for t in texts]


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then some more words follow here"),
    (2, "short item"),
    (10, "Short, ITEM!"),
    (3, None),
    (4, "  ...  "),
    (None, "the lazy dog and then some more words follow here at last"),
    (5, "one"),
    (1, "another text of the same item with ten words in it"),
]
LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = [
    (1, "nothing to see"), (2, None), (3, ""), (4, "a short-item, THE QUICK brown fox jumps over the lazy dog and x"), (5, "...one..."), (None, "short item " * 40),
    (6, LONG + " another text of the same item with ten words in it " + LONG), (6, "repeated id: short item"), (7, "the lazy dog and then some more words follow here"), (7, "the lazy dog and then some more words follow here"),
]


def tables(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, items string"),
        spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, n_words int"),
    )


def told(rows):
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in rows), key=str)


@pytest.mark.parametrize("shard", [1 << 20, 100])
def test_one_pass_and_many(spark, shard):
    docs, items = tables(spark)
    got = leaks.contamination(docs, items, shard=shard).collect()
    assert told(got) == sorted(((d, *brute(t, ITEMS)) for d, t in DOCS), key=str)
    spans = [(s.start, s.end) for r in got if r.doc_id is None for s in r.spans]
    assert spans == [(0, 80)]


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert leaks.contamination(docs.limit(0), items).count() == 0
    assert {(r.doc_id, len(r.spans), len(r["items"])) for r in leaks.contamination(docs, items.limit(0)).collect()} == {(d, 0, 0) for d, _ in DOCS}


def test_drop_contaminated(spark):
    docs, items = tables(spark)
    assert sorted(r.doc_id for r in leaks.drop_contaminated(docs, items).collect()) == [1, 2, 3]
    assert 6 not in [r.doc_id for r in leaks.drop_contaminated(docs, items, 0.4).collect()]  # half of its second row is hit
    assert 4 in [r.doc_id for r in leaks.drop_contaminated(docs, items, 0.95).collect()]


def test_query_equals_sql_and_plain_search(spark, tmp_path):
    docs, items = tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in queries.op12_benchmark_decontamination(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in DOCS:
        n, hit, ids = brute(t, ITEMS)
        want.append((d, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=str)
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert sorted(db.sql(leaks.ORACLE).fetchall(), key=str) == got
