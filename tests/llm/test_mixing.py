import hashlib
import itertools
import random
import re

import pytest
from foliate.llm import mixing
from pyspark.sql import functions as F


def table(spark, extra=True):
    rows = [(i, "word " * ((i * 7919) % 60), f"s{i % 3 if i % 2 else 0}") for i in range(400)]
    if extra:
        rows += [(400, None, "s0"), (401, "", "s1"), (402, "one two", None), (402, "one two", None), (None, "a b c", "s2"), (403, "long " * 20000, "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    quota, out = mixing.targets(sums), []
    for s in sums:
        own = sorted((hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest(), size(t), i) for i, t, x in rows if x == s)
        base, rest = divmod(int(quota[s]), sums[s]) if sums[s] else (0, 0)
        for o, n, i in own:
            upto = sum(m for p, m, _ in own if (p, m) <= (o, n))
            out.append((i, n, sums[s], quota[s], n * min(2, base + (upto - n / 2 <= rest))))
    return sorted(out, key=repr)


def test_equals_brute_force_and_meets_the_targets(spark):
    df = table(spark)
    got = mixing.taken(df, F.array("source")).select("doc_id", "mix.size", F.col("mix.plan.source_sizes")[0], F.col("mix.plan.targets")[0], (F.col("mix.size") * F.col("mix.copies")).cast("long"))
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute([tuple(r) for r in df.collect()])
    assert all(t <= 2 * n for _, n, _, _, t in got)


def test_documents_come_as_often_as_taken(spark):
    df = table(spark, False).withColumn("size", F.lit("clash")).withColumn("mix", F.lit(1))
    df = df.drop("mix")
    out = mixing.mix(df, F.array("source"))
    assert out.columns == df.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    sizes = {r.source: r.n for r in df.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    for s, target in mixing.targets(sizes).items():
        assert abs(words[s] - target) <= 30
    assert sorted(map(tuple, mixing.mix(df.repartition(7), F.array("source")).collect())) == sorted(map(tuple, out.collect()))


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 200, "b": 166.6666667, "c": 83.3333333})
    assert mixing.targets({"a": 0, None: 0}) == {"a": 0.0, None: 0.0}
    assert mixing.targets({}) == {}


def test_flow_over_overlapping_sources_is_largest_and_cheapest():
    patterns = [(frozenset("a"), 3), (frozenset("ab"), 4), (frozenset("bc"), 2), (frozenset("c"), 1)]
    quotas = {"a": 5, "b": 6, "c": 5}
    flow = mixing.allocate(patterns, quotas)
    cost = lambda total, size: max(0, total - size)
    got = (sum(sum(f.values()) for f in flow), sum(cost(sum(f.values()), n) for f, (_, n) in zip(flow, patterns)))
    for s in quotas:
        assert sum(f.get(s, 0) for f in flow) <= quotas[s]
    best = (0, 0)
    for ab, bb, bc, cc in itertools.product(range(9), range(9), range(5), range(5)):
        if ab + bb > 8 or bc + cc > 4:
            continue
        a, c = min(6, 5 - ab) if ab <= 5 else -1, min(2, 5 - cc)
        if a < 0 or bb + bc > 6 or c < 0:
            continue
        total = a + ab + bb + bc + cc + c
        best = max(best, (total, -(cost(a, 3) + cost(ab + bb, 4) + cost(bc + cc, 2) + cost(c, 1))))
    assert got == (best[0], -best[1])


def test_overlapping_sources_end_to_end(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), ["x"] if i % 3 else ["y", "x", None]) for i in range(300)], "doc_id long, text string, source array<string>")
    rows = mixing.taken(df, F.col("source")).select("mix").collect()
    given = {}
    for r in rows:
        key = tuple(r.mix.plan.pattern)
        given.setdefault(key, [0, r.mix.plan.given])[0] += r.mix.size * r.mix.copies
    assert len(given) == 2 and all(abs(a - b) <= 5 for a, b in given.values())


def test_empty_table_and_too_many_patterns(spark, monkeypatch):
    assert mixing.taken(table(spark).where("false"), F.array("source")).count() == 0
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError):
        mixing.plan(table(spark), F.array("source"))


def test_any_number_of_single_sources(spark, monkeypatch):
    df = table(spark)
    more = spark.createDataFrame([(1000 + i, "w " * (i * 31 % 17), f"host{i * 7 % 90}") for i in range(500)], df.schema)
    df = df.union(more)
    few = mixing.taken(df, F.array("source")).select("doc_id", "mix").collect()
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    many = mixing.taken(df, F.array("source")).select("doc_id", "mix").collect()
    assert sorted(map(repr, many)) == sorted(map(repr, few))
    some = mixing.taken(df, F.array("source")).select("doc_id", "mix.size", F.col("mix.plan.source_sizes")[0], F.col("mix.plan.targets")[0], (F.col("mix.size") * F.col("mix.copies")).cast("long"))
    assert sorted((tuple(r) for r in some.collect()), key=repr) == brute([tuple(r) for r in df.collect()])


def test_no_network_for_single_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "allocate", None)
    assert mixing.taken(table(spark), F.array("source")).count() == 406


def test_too_many_overlapping_patterns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError):
        mixing.taken(table(spark), F.array("source", F.lit("x")))


def test_many_documents_without_a_source(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 6), [] if i % 5 == 0 else [f"s{i % 4}"]) for i in range(120)], "doc_id long, text string, source array<string>")
    few = mixing.taken(df, F.col("source")).select("doc_id", "mix").collect()
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    assert sorted(map(repr, mixing.taken(df, F.col("source")).select("doc_id", "mix").collect())) == sorted(map(repr, few))


def test_flow_equals_the_least_cut_for_every_number_of_copies():
    rng = random.Random(1)
    for trial in range(150):
        names = [f"s{i}" for i in range(rng.randint(1, 6))] + [None] * (trial % 2)
        patterns = [(frozenset(rng.sample(names, rng.randint(0, min(4, len(names))))), rng.randint(0, 40)) for _ in range(rng.randint(1, 12))]
        quotas, copies = {s: rng.randint(0, 90) for s in names}, rng.randint(1, 3)

        def cut(c):
            sets = itertools.chain.from_iterable(itertools.combinations(names, r) for r in range(len(names) + 1))
            return min(sum(quotas[s] for s in t) + sum(c * n for m, n in patterns if not m <= set(t)) for t in sets)

        given = mixing.allocate(patterns, quotas, copies)
        assert all(sum(g.get(s, 0) for g in given) <= quotas[s] for s in names)
        assert all(set(g) <= m and all(n >= 0 for n in g.values()) for g, (m, _) in zip(given, patterns))
        for c in range(1, copies + 1):  # first copies are used as far as they can be before second ones, and so on
            assert sum(min(sum(g.values()), c * n) for g, (_, n) in zip(given, patterns)) == cut(c)


def test_flow_of_many_patterns():
    rng = random.Random(2)
    names = [f"s{i}" for i in range(500)]
    patterns = [(frozenset(rng.sample(names, rng.randint(1, 4))), rng.randint(1, 1000)) for _ in range(60_000)]
    quotas = {s: 2 * 150_000 if i % 2 else 10_000 for i, s in enumerate(names)}
    given = mixing.allocate(patterns, quotas)
    assert all(sum(g.values()) <= 2 * n for g, (_, n) in zip(given, patterns))
    filled = dict.fromkeys(names, 0)
    for g in given:
        for s, n in g.items():
            filled[s] += n
    assert all(filled[s] <= quotas[s] for s in names) and all(filled[s] == 10_000 for s in names[::2])


def test_rows_without_doc_id_share_a_place_in_the_order(spark):
    rows = [(None, "w " * (i % 7), "s0") for i in range(300)] + [(i, "w " * 5, "s1") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df, F.array("source")).select("doc_id", "mix.size", F.col("mix.plan.source_sizes")[0], F.col("mix.plan.targets")[0], (F.col("mix.size") * F.col("mix.copies")).cast("long"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
