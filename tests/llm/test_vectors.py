import duckdb
import numpy as np
import pyarrow as pa
from foliate.llm import vectors


def brute(rows, cosine=0.9):
    good = {}
    for i, e in rows:
        if i is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        good[i] = min(good.get(i, e), e)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]):
                x, y = np.array(good[a]), np.array(good[b])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {i: (links[i], find(i)) for i in parent}


def rows(n=260, dim=16):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, dim))
    out = []
    for i in range(n):
        c = centres[i % 12] if i % 3 else rng.standard_normal(dim)
        out.append((i, [float(np.float32(x)) for x in c + rng.standard_normal(dim) * (0.15 + 0.3 * rng.random())]))
    out[7] = (7, out[8][1])
    return out + [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [1.0, None] * (dim // 2)), (n + 5, [float("inf")] * dim), (n + 6, [1.0, 2.0]), (n + 7, [1.0, 2.0])]


def result(spark, data, **options):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return vectors.near_duplicates(df, **options).collect()


def test_equals_brute_force(spark):
    data = rows()
    data += [(300 + i, data[i % 3][1]) for i in range(30)]  # common vectors
    want = brute(data)
    for meet in (512, 16):  # in small blocks too
        got = result(spark, data, recall=1 - 1e-9, meet=meet)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, 9), (1, v, 8), (None, v, 7), (2, v, 6)], "vec_id long, embedding array<float>, n_links int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == [(-1, 0, -1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_plan_keeps_recall_as_rows_grow():
    for n in (10, 10_000, 10**9):
        bits, tables = vectors.plan(n)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= 0.999
        assert n / 2**bits <= vectors.BUCKET


def planted(n, dim, seed):
    """n pairs of unit vectors at a cosine of 0.9 to 0.92."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    c = rng.uniform(0.9 + 1e-9, 0.92, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * b


def test_shipped_settings_meet_and_screen_planted_pairs_at_any_size():
    a, b = planted(3000, 64, 1)
    for n in (50_000, 10**6, 10**8):
        bits, tables = vectors.plan(n)
        batch = lambda x: pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], ["vec_id", "embedding"])
        p, q = (vectors._sketches(next(vectors._hash(iter([batch(x)]), bits, tables, vectors.SEED)).column(2)) for x in (a, b))
        differ = np.unpackbits(p ^ q, axis=1)[:, : bits * tables]
        met = (~differ.reshape(-1, tables, bits).any(2)).any(1) & (differ.sum(1) <= vectors.most_unlike(bits * tables, 0.9))
        assert met.mean() >= 0.995


def test_recall_of_the_shipped_settings_and_sql_agree_on_planted_links(spark):
    a, b = planted(400, 32, 2)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(3000), np.concatenate([a, b, rng.standard_normal((1500, 32)), np.tile(a[:1], (200, 1))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    table = pa.table({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("embeddings", table)
    want = sorted(con.execute(vectors.ORACLE).fetchall())
    assert sum(r[1] for r in want) > 40_000  # 201 equal vectors and 400 pairs
    assert len(got) == len(want) and sum(x != y for x, y in zip(got, want)) <= 0.01 * 800
