import json

from foliate.operators import state

ROWS = [("same", "h1", ["same.md"]), ("edited", "h0", ["edited.md"]), ("lost", "h3", ["lost.md", "lost2.md"]), ("format", "h4", ["format.txt"]), ("old", "h9", ["old.md"]), ("none", "h5", [])]


def frames(spark):
    known = spark.createDataFrame([(u, h, f, "t", "then") for u, h, f in ROWS], state.SCHEMA)
    pages = spark.createDataFrame([("same", "h1"), ("edited", "h2"), ("lost", "h3"), ("format", "h4"), ("fresh", "h6"), ("none", "h5")], "url string, hash string")
    files = spark.createDataFrame([("same.md",), ("edited.md",), ("lost.md",), ("format.txt",)], "path string")
    return pages, known, files


def test_classify(spark):
    pages, known, files = frames(spark)
    got = {r.url: r.status for r in state.classify(pages, known, files, ".md").collect()}
    assert got == {"same": "unchanged", "edited": "changed", "lost": "changed", "format": "changed", "fresh": "new", "none": "changed"}
    assert {r.status for r in state.classify(pages, known, files, ".md", force=True).collect()} == {"changed", "new"}


def test_upsert_tombstones_and_snapshots(spark, tmp_path):
    pages, known, files = frames(spark)
    fresh = spark.createDataFrame([("edited", "h2", ["n.md"], "t2", "now"), ("fresh", "h6", ["f.md"], "t", "now")], state.SCHEMA)
    store = state.Store(spark, str(tmp_path / "s"))
    assert store.load().count() == 0
    store.save(known)
    store.save(state.upsert(store.load(), fresh))
    now = {r.url: r.hash for r in store.load().collect()}
    assert now == {u: h for u, h, _ in ROWS} | {"edited": "h2", "fresh": "h6"}
    (tmp_path / "s" / "v9").mkdir()  # a snapshot whose writer died
    assert state.tracked(store.load()) == 7
    assert {r.url for r in state.tombstones(store.load(), pages).collect()} == {"old"}
    assert "n.md" in {r.path for r in state.all_files(store.load()).collect()}


def test_json(spark, tmp_path):
    _, known, _ = frames(spark)
    state.export_json(known, str(tmp_path / "x.json"))
    data = json.loads((tmp_path / "x.json").read_text())
    assert data["lost"] == {"hash": "h3", "file": "lost.md", "title": "t", "updated_at": "then"} and data["none"]["file"] == ""
    back = state.from_json(spark.read.text(str(tmp_path / "x.json"), wholetext=True))
    assert {r.url for r in back.collect()} == {u for u, _, _ in ROWS}
    assert state.from_json(spark.createDataFrame([("broken {",)], "value string")).count() == 0


def test_changes_add_up_to_the_same_state_as_rewriting_it(spark, tmp_path, monkeypatch):
    import os
    import random

    monkeypatch.setattr(state, "COMPACT", 4)
    rng, store, want = random.Random(2), state.Store(spark, str(tmp_path / "s")), {}
    rows = lambda run, urls: spark.createDataFrame([(u, f"h{run}", [f"{u}.md"], "t", str(run)) for u in urls], state.SCHEMA)
    for run in range(11):
        fresh = rng.sample(["a", "b", "c", "d", "e", "f"], rng.randrange(4))
        gone = rng.sample(["a", "b", "g"], rng.randrange(3))
        store.put(rows(run, fresh), spark.createDataFrame([(u,) for u in gone], "url string"))
        want = {u: h for u, h in want.items() if u not in gone} | {u: f"h{run}" for u in fresh}
        assert {r.url: (r.hash, r.updated_at) for r in store.load().collect()} == {u: (h, h[1:]) for u, h in want.items()}
        if run == 5:
            (tmp_path / "s" / "d99").mkdir()  # changes whose writer died
    names = sorted(n for n in os.listdir(tmp_path / "s") if n != "d99")
    bases = [n for n in names if n[0] == "v"]
    assert len(bases) <= 2 and len(names) <= 2 + 2 * state.COMPACT  # older ones went
    store.save(store.load())
    assert {r.url: r.hash for r in store.load().collect()} == want


def test_what_is_written_is_in_proportion_to_the_changes(spark, tmp_path):
    import glob
    import os

    store = state.Store(spark, str(tmp_path / "s"))
    big = spark.range(20_000).selectExpr("concat('u', id) as url", "sha2(cast(id as string), 256) as hash", "array('f.md') as files", "'t' as title", "'now' as updated_at")
    store.put(big)
    store.put(big.where("url = 'u7'").selectExpr("url", "'new' as hash", "files", "title", "updated_at"))
    size = lambda name: sum(os.path.getsize(p) for p in glob.glob(f"{tmp_path}/s/{name}/*.parquet"))
    assert size("d2") < size("d1") / 50 and store.load().count() == 20_000
    assert store.load().where("url = 'u7'").first().hash == "new"
