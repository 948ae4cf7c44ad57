import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from foliate.llm import pu, queries
from foliate.llm.textkit import buffers

CLEAN = "The quiet river runs past number {i} of the old mills, and people walk there in spring."
JUNK = "BUY {i} NOW!!! ### $$$ %%% &&& *** BUY BUY BUY!!!"


def table(spark, n=300):
    rows = [(i, (JUNK if i % 4 == 0 else CLEAN).format(i=i * 37 % 91)) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, ""), (1, rows[1][1])], "doc_id long, text string")


def test_learns_from_positives_and_unlabelled_texts_only(spark):
    docs = table(spark)
    model = pu.fit(docs, docs.where("doc_id % 4 <> 0 and doc_id % 3 = 0 and doc_id < 300"))
    assert 0.6 < model.prior < 0.95
    out = pu.scores(docs, model).collect()
    assert len(out) == 303
    body = [r for r in out if r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in body]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id >= 300}) == 1
    again = pu.scores(docs.repartition(5), pu.fit(docs.repartition(7), docs.where("doc_id % 4 <> 0 and doc_id % 3 = 0 and doc_id < 300")))
    assert {r.doc_id: r.score for r in again.collect()} == pytest.approx({r.doc_id: r.score for r in out}, abs=1e-6)
    kept = pu.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_no_positives_no_documents(spark):
    docs = table(spark, 8)
    model = pu.fit(docs, docs.where("false"))
    assert {r.score for r in pu.scores(docs, model).collect()} == {0.5}
    empty = docs.where("false")
    assert pu.scores(empty, pu.fit(empty, empty)).count() == 0


def test_risk_is_not_negative_and_matches_its_definition():
    p, u = np.array([2.0, -1.0]), np.array([0.5, 3.0, -4.0])
    plus, minus = pu.nonnegative_risk(p, u, 0.4)
    log = lambda z: np.log1p(np.exp(-z))
    assert plus == pytest.approx(0.4 * np.mean(log(p)))
    assert minus == pytest.approx(np.mean(log(-u)) - 0.4 * np.mean(log(-p)))


def test_prior_estimate_on_a_known_mixture():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    u = np.where(rng.random(4000) < 0.7, rng.normal(2, 1, 4000), n)
    cuts = pu._cuts(p)
    assert pu.estimate_prior(pu._shares(p, cuts), len(p), pu._shares(u, cuts), len(u)) == pytest.approx(0.7, abs=0.05)


def test_features_are_the_same_alone_and_in_a_block():
    texts = ["a b c a b c", "", "Zwölf Boxkämpfer\njagen |||", "x" * 100_000]
    both = pu.features(*buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(both[i], pu.features(*buffers(pa.array([t])))[0], atol=1e-6)


def plain_features(text):
    """The features by their definition, a text and a word at a time."""
    raw = text.encode()
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return np.zeros(19 + pu.TRIGRAMS)
    n, size = len(w), len(raw)
    of = lambda chars: sum(c in chars for c in raw) / size
    out = [of(range(65, 91)), of(range(97, 123)), of(range(48, 58)), of(range(128, 256)), of(b"#*$%&|<>"), of(b"!?"), of(b",."), of(b"\t\n\x0b\x0c\r "), of(b"\n"), of(b"|")]
    lengths, many = [len(x.encode()) for x in w], Counter(w)
    runs = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    inside = {i + j for i in range(n - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out += [
        sum(lengths) / n / 10, sum(x > 20 for x in lengths) / n, sum(many[x] == 1 for x in w) / n, sum("A" <= x[0] <= "Z" for x in w) / n,
        sum(a == b for a, b in zip(w, w[1:])) / n, len(inside) / n, (len(lines) - len(set(lines))) / max(raw.count(b"\n"), 1), np.log1p(n) / 10, min(n, 20) / 20,
    ]
    t = np.zeros(pu.TRIGRAMS)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        g = (int(pu._HASH[0][a]) + int(pu._HASH[1][b]) + int(pu._HASH[2][c])) % 2**32
        t[(g * 2654435761 % 2**32) >> 24] += 1
    return np.concatenate([out, np.sqrt(t / size)])


TEXTS = ["a b c a b c", "Zwölf Boxkämpfer\njagen |||\n\n jagen |||\njagen |||", "The END, the end!? " * 9, "x" * 3000, "one\ntwo\none\n\n \none", "é 漢字 ok ok ok"]


def test_features_equal_their_definition():
    got = pu.features(*buffers(pa.array(["", *TEXTS, " \n"])))
    assert np.allclose(got, [plain_features(t) for t in ["", *TEXTS, " \n"]], atol=1e-6)


def test_scores_equal_the_formula(spark):
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate([None, "", *TEXTS])], "doc_id long, text string")
    clash = docs.selectExpr("doc_id", "text", "1 as score", "'x' as predicted", "2 as doc", "null as positive")
    model = pu.fit(clash, docs.where("doc_id in (2, 4)"))
    got = pu.scores(clash, model).collect()
    x = np.array([plain_features(t or "") for t in [None, "", *TEXTS]], np.float32)
    assert np.allclose(model.centre, np.minimum(x, 100).mean(0), atol=1e-5) and np.allclose(model.scale, np.minimum(x, 100).std(0) + 1e-3, atol=2e-3)
    want = []
    for row in x.astype(float):
        z = [min(8.0, max(-8.0, (v - c) / s)) for v, c, s in zip(row, model.centre, model.scale)]
        n = np.expm1(10 * row[17])
        z = [v * (n / (n + pu.SHRINK) if i >= 19 else 1) for i, v in enumerate(z)]
        want.append(1 / (1 + np.exp(-sum(v * w for v, w in zip(z, model.w)) - model.b)))
    assert sorted(r.score for r in got) == pytest.approx(sorted(want), abs=1e-4)
    assert all(r.predicted == (r.score >= 0.3) for r in got) and [r.doc_id for r in got].count(None) == 1
    assert pu.keep_quality(clash, model).columns == clash.columns
    assert [r.h for r in docs.select(pu.held_out().alias("h"), "doc_id").collect() if r.doc_id is None] == [False]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op9_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_features_table_and_scores_from_it(spark):
    docs = table(spark, 40)
    rows = pu.featured(docs)
    assert rows.columns == ["doc_id", "x"] and rows.count() == docs.count()
    got = {(r.doc_id, bytes(r.x)) for r in rows.collect()}
    assert got == {(r.doc_id, pu.features(*buffers(pa.array([r.text or ""])))[0].tobytes()) for r in docs.collect()}
    model = pu.fit_features(rows, docs.where("doc_id % 4 <> 0"))
    key = lambda r: (r.doc_id, r.score, r.predicted)
    assert sorted(map(key, pu.score_features(rows, model).collect())) == sorted(map(key, pu.scores(docs, model).collect()))


def test_a_doc_id_on_very_many_rows_enters_the_samples_once(spark):
    docs = table(spark, 60)
    many = docs.union(spark.range(20_000).selectExpr("1L as doc_id", "'the same text' as text"))
    sizes = []
    plain = pu.train
    try:
        pu.train = lambda p, u, *rest: sizes.append((len(p), len(u))) or plain(p, u, *rest)
        pu.fit(many, docs.where("doc_id in (1, 2, 3)"), 50)
    finally:
        pu.train = plain
    assert sizes == [(sizes[0][0], sizes[0][1])] and sizes[0][0] <= 4 and sizes[0][1] <= 50


def test_last_steps_lower_the_risk_over_all_documents():
    """And are those of the sums over all, whatever the sample was."""
    rng = np.random.default_rng(3)
    p, every = rng.normal(1, 0.5, (200, 4)), np.concatenate([rng.normal(1, 0.5, (500, 4)), rng.normal(-1, 0.5, (500, 4))])
    seen = []

    def gradient(model):
        z = every @ model.w + model.b
        s = pu._sigmoid(z)
        seen.append(pu.nonnegative_risk(p @ model.w + model.b, z, 0.5))
        return pu._loss(-z).mean(), np.append(every.T @ s, s.sum()) / len(every)

    last = pu._refined(pu.Model(np.zeros(4), np.ones(4), np.zeros(4), 0.0, 0.5), p, gradient, 1e-3)
    risks = [a + max(0, b) for a, b in seen]
    assert len(risks) == pu.REFINE and risks == sorted(risks, reverse=True) and all(b >= 0 for _, b in seen)
    assert (last.w > 0).all() and (p @ last.w + last.b).mean() > 0 > (every[500:] @ last.w + last.b).mean()
