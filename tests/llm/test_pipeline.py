import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from foliate.llm import pu, queries
from pyspark.sql import functions as F

from . import test_minhash, test_mixing, test_suffixes


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean documents in four sources, junk, copies, near copies, shared passages, nulls and clashing columns."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    passage = text(70)
    rows, labels = [], []
    for i in range(320):
        kind = i % 16
        if kind == 3:
            t = "BUY NOW!!! ### $$$ %%% " * rng.randrange(10, 30)
        elif kind == 5 and i > 20:
            t = rows[i - 5][1]
        elif kind == 6 and i > 20:
            w = (rows[i - 6][1] or "").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif kind == 9:
            t = text(60) + "\n" + passage + "\n" + text(60)
        else:
            t = text(rng.randrange(60, 400))
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
        if i % 3 == 0 or kind == 3:
            labels.append((i, int(kind != 3), 0))
    rows += [(320, None, None, None, None), (321, "", "en", "src1", 0), (None, text(90), "en", "src2", 9), (322, text(3000), "en", "src3", 9)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        before = rows_of(docs) if name != names[-1] else None
        if name != names[-1]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept.append(out.count())
        if name == names[0]:
            scored = pu.scores(docs, queries.quality_model(spark, docs, sf_dir)).where("score >= 0.3")
            assert sorted(map(repr, (r.doc_id for r in scored.collect()))) == sorted(repr(i) for i, _ in rows_of(out))
            assert not any("BUY" in (t or "") for _, t in rows_of(out)) and out.count() > 280
        elif name == names[1]:
            group = test_minhash.brute_groups([(i, t) for i, t in before if i is not None])
            assert rows_of(out) == [(i, t) for i, t in before if i is None or group[i] == i]
        elif name == names[2]:
            gone = test_suffixes.brute(before, 50)
            want = [(i, [w for p, w in enumerate(test_suffixes.words(t)) if i is None or p not in gone[i]]) for i, t in before]
            assert sorted(((i, test_suffixes.words(t)) for i, t in rows_of(out)), key=repr) == sorted(want, key=repr)
            assert sum(map(len, gone.values())) > 300 and out.where("n_chars <> length(text)").count() == 0
        elif name == names[3]:
            plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
            want = Counter()
            for i, n, _, _, taken in test_mixing.brute(plain):
                want[i] += taken // n if n else 0
            assert Counter(i for i, _ in rows_of(out)) == +want
        else:
            check_packing(docs, out)
        docs = out
    assert kept[1] < kept[0] and kept[3] != kept[2]


def check_packing(docs, out):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, text in rows_of(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    got = out.collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) <= 2048


def test_run_is_the_stages_in_order(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(tuple, out.select("doc_id", "piece", "ids_crc32").collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_takes_extra_columns_with_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for c in ("score", "kept", "group_id", "spans", "size", "mix", "item", "bin", "offset", "_spans", "trusted"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.select("score", "mix", "_spans").distinct().count() == 1, name
    assert re.match("doc_id", corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns[0])
