"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern, the set of sources they belong to.
A flow network routes token capacity from patterns to source quotas: a pattern
passes its own size at cost 0, the same again at cost 1 for second copies, and
so on, so repetition is convex and spread evenly before anything repeats again.
The cheapest largest flow says how many tokens each pattern gives. Within a
pattern, every document is taken as often as the flow covers the whole pattern,
and the rest goes to documents in a seeded order.

The place in the seeded order where the rest is used up is found by summing
sizes under ever longer prefixes of the order's hash, so no source is ever
sorted or gathered, and the last few documents alone are ranked.

What comes to the driver is one row per pattern, at most MOST_PATTERNS; the same
bound holds for what is broadcast. Where every pattern has one source, the flow
is the whole part of each target, without a network; beyond MOST_PATTERNS of
them, taken() and mix() get the same plan from DataFrames alone. More patterns
than that with overlapping sources are an error.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take nothing; rows with the same doc_id and
size fall together; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .workspace import Workspace

WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
SEED = "mix-1"
MOST_PATTERNS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: int = COPIES) -> dict[str | None, float]:
    """Words each source shall give. Shares follow the weights; what is over most times a source's size is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out | {s: left * weight[s] / total for s in free}


def allocate(patterns: list[tuple[frozenset, int]], quotas: dict, copies: int = COPIES) -> list[dict]:
    """Per pattern (sources, size), the tokens it gives to each source.

    Among the flows that fill the quotas as far as possible it is one of least repetition cost: a pattern's c-th copy
    costs c - 1 a token. No other arc has a cost and a path passes one of these, so cheapest paths first means the first
    copies first: each copy's capacity is opened in turn and the flow made largest, by blocking flows.
    """
    sources = sorted(quotas, key=lambda s: (s is None, s or ""))
    node = {s: i for i, s in enumerate(sources)}
    own = [sorted(node[s] for s in members) for members, _ in patterns]
    given: list[dict[int, int]] = [dict.fromkeys(o, 0) for o in own]
    takers: list[dict[int, None]] = [{} for _ in sources]  # patterns that give to the source now
    room, supply = [int(quotas[s]) for s in sources], [0] * len(patterns)
    for _ in range(copies):
        for i, (_, size) in enumerate(patterns):
            supply[i] += size
        while _blocking_flow(own, given, takers, room, supply):
            pass
    return [{sources[j]: n for j, n in g.items()} for g in given]


def _blocking_flow(own: list, given: list, takers: list, room: list, supply: list) -> int:
    """Pushes what fits along paths of the least number of steps, from patterns with supply to sources with room; a step back undoes what a pattern gives."""
    rank_p, rank_s = [-1] * len(own), [-1] * len(room)
    layer, step, ends = [i for i, n in enumerate(supply) if n and own[i]], 0, False
    for i in layer:
        rank_p[i] = 0
    starts = layer
    while layer and not ends:
        step += 1
        reached = []
        for i in layer:
            for j in own[i]:
                if rank_s[j] < 0:
                    rank_s[j] = step
                    reached.append(j)
                    ends = ends or room[j] > 0
        step += 1
        layer = []
        for j in reached if not ends else ():
            for i in takers[j]:
                if rank_p[i] < 0:
                    rank_p[i] = step
                    layer.append(i)
    if not ends:
        return 0
    pushed, next_p, back = 0, [0] * len(own), [None] * len(room)
    for start in starts:
        while supply[start]:
            path = [start]  # patterns and sources in turn
            while path:
                if len(path) % 2:  # at a pattern
                    i = path[-1]
                    while next_p[i] < len(own[i]) and rank_s[own[i][next_p[i]]] != rank_p[i] + 1:
                        next_p[i] += 1
                    if next_p[i] == len(own[i]):
                        path.pop()
                        if path:
                            back[path[-1]].pop()
                        continue
                    path.append(own[i][next_p[i]])
                    continue
                j = path[-1]
                if room[j]:
                    break
                if back[j] is None:
                    back[j] = [i for i in takers[j] if rank_p[i] == rank_s[j] + 1]
                while back[j] and not given[back[j][-1]][j]:
                    back[j].pop()
                if back[j]:
                    path.append(back[j][-1])
                else:  # a dead end for everyone
                    path.pop()
                    next_p[path[-1]] += 1
            if not path:
                break
            flow = min(supply[start], room[path[-1]], *(given[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2)))
            for k in range(0, len(path), 2):
                i, j = path[k], path[k + 1]
                given[i][j] += flow
                takers[j][i] = None
                if k + 2 < len(path):
                    given[path[k + 2]][j] -= flow
                    if not given[path[k + 2]][j]:
                        takers[j].pop(path[k + 2])
            supply[start] -= flow
            room[path[-1]] -= flow
            pushed += flow
    return pushed


def _order(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(docs: DataFrame, sources: Column, seed: str = SEED, copies: int = COPIES, ws: Workspace | None = None, **weighing) -> DataFrame:
    """One row per pattern: pattern (sorted array of sources), size, given, base, last_order, last_size, targets, source_sizes.

    A document takes base copies, and one more if (its order, its size) is at most (last_order, last_size).
    docs: doc_id, text and what sources needs.
    """
    sized = _sized(docs, sources, seed, ws or Workspace(docs.sparkSession, "mixing"))
    return _planned(sized, _patterns(sized), copies, **weighing)


def _sized(docs: DataFrame, sources: Column, seed: str, ws: Workspace) -> DataFrame:
    return ws.save(docs.select(_pattern(sources).alias("pattern"), n_words(F.col("text")).alias("size"), _order(F.col("doc_id"), seed).alias("o")), "sizes")


def _patterns(sized: DataFrame) -> list:
    """Patterns with their sizes; one more than MOST_PATTERNS stands for any number more."""
    return sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()


def _planned(sized: DataFrame, rows: list, copies: int, **weighing) -> DataFrame:
    spark = sized.sparkSession
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    rows.sort(key=lambda r: [(s is None, s or "") for s in r.pattern])
    sizes: dict = {}
    for r in rows:
        for s in r.pattern:
            sizes[s] = sizes.get(s, 0) + r.size
    quota = targets(sizes, most=copies, **weighing)
    if all(len(r.pattern) < 2 for r in rows):  # nothing to choose, and no target is over copies times the size
        flows = [{s: int(quota[s]) for s in r.pattern} for r in rows]
    else:
        flows = allocate([(frozenset(r.pattern), r.size) for r in rows], quota, copies)
    state = []
    for r, flow in zip(rows, flows):
        given = sum(flow.values())
        base = given // r.size if r.size else 0
        state.append((r.pattern, r.size, given, base, given - base * r.size, "", 0, [quota[s] for s in r.pattern], [sizes[s] for s in r.pattern]))
    schema = "pattern array<string>, size long, given long, base long, rest long, prefix string, before long, targets array<double>, source_sizes array<long>"
    where = spark.createDataFrame(state, schema)
    for length in (3, 6, 9):
        # the prefix under which the running sum passes the rest
        inside = sized.join(F.broadcast(where.select("pattern", "prefix", "before", "rest")), "pattern").where(F.col("o").startswith(F.col("prefix")))
        sums = inside.groupBy("pattern", F.substring("o", 1, length).alias("p")).agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        run = F.sum("size").over(Window.partitionBy("pattern").orderBy("p")) + F.col("before")
        passing = sums.withColumn("upto", run).where("upto > rest").groupBy("pattern").agg(F.min_by(F.struct("p", (F.col("upto") - F.col("size")).alias("before")), "p").alias("x"))
        found = passing.select("pattern", F.col("x.p").alias("np"), F.col("x.before").alias("nb"))
        got = {tuple(r.pattern): (r.np, r.nb) for r in found.collect()}
        # without a passing prefix all is used: no prefix starts with "~", and every order is below it
        state = [(*s[:5], *got.get(tuple(s[0]), ("~", 0)), *s[7:]) for s in state]
        where = spark.createDataFrame(state, schema)
    last = sized.join(F.broadcast(where.select("pattern", "prefix", "before", "rest")), "pattern").where(F.col("o").startswith(F.col("prefix")))
    last = _running(last).where("upto - size / 2 <= rest").groupBy("pattern").agg(F.max(F.struct("o", "size")).alias("last"))
    got = {tuple(r.pattern): tuple(r["last"]) for r in last.collect()}
    out = [(*s[:4], *got.get(tuple(s[0]), (s[5], -1)), *s[7:]) for s in state]
    return spark.createDataFrame(out, "pattern array<string>, size long, given long, base long, last_order string, last_size long, targets array<double>, source_sizes array<long>")


def _running(last: DataFrame) -> DataFrame:
    """Sizes that share a place in the order added up, with upto: the sum up to there. Rows without a doc_id share one place,
    so it is distinct sizes, not rows, that a window holds of them."""
    last = last.groupBy("pattern", "o", "size").agg(F.sum("size").alias("all"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    return last.withColumn("upto", F.sum("all").over(Window.partitionBy("pattern").orderBy("o", "size")) + F.col("before"))


def _ranked(sums: DataFrame, ws: Workspace) -> DataFrame:
    """sums (pattern of one source, size) with nth, the source's place in order, null last; no window spans all of them."""
    source = F.get("pattern", F.lit(0)).asc_nulls_last()
    parts = ws.save(sums.orderBy(source).withColumn("part", F.spark_partition_id()), "sources")
    before, n = [], 0
    for row in parts.groupBy("part").count().orderBy("part").collect():
        before.append((row["part"], n))
        n += row["count"]
    offsets = sums.sparkSession.createDataFrame(before, "part int, offset long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(source)) - 1 + F.col("offset")
    return parts.join(F.broadcast(offsets), "part").select("pattern", "size", nth.alias("nth"))


def _wide(sized: DataFrame, copies: int, ws: Workspace, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """plan() for any number of patterns of one source or none: steps and results of targets() and _planned(), none collected."""
    sums = ws.save(sized.groupBy("pattern").agg(F.sum("size").alias("size")), "patterns")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = ws.save(_ranked(sums.where("size(pattern) = 1"), ws).select("pattern", "size", weight.alias("weight")), "weights")
    whole = share * (weighed.agg(F.sum("size")).first()[0] or 0)
    most, over, n_over, level = F.col("size") * copies, F.lit(False), -1, F.lit(0.0)
    while True:  # sources join those over until their number stays
        row = weighed.agg(F.sum(F.when(~over, F.col("weight"))).alias("free"), F.sum(F.when(over, most)).alias("given"), F.count_if(over).alias("n")).first()
        if row.n == n_over or not row.free:
            break
        level = F.lit(float(whole - (row.given or 0))) * F.col("weight") / F.lit(float(row.free))
        n_over, over = row.n, over | (level > most)
    singles = weighed.select("pattern", "size", F.when(over, most.cast("double")).otherwise(level).alias("target"))
    singles = singles.select("pattern", "size", F.floor("target").alias("given"), F.array("target").alias("targets"), F.array("size").alias("source_sizes"))
    none = sums.where("size(pattern) = 0").select("pattern", "size", F.lit(0).cast("long").alias("given"), F.array().cast("array<double>").alias("targets"), F.array().cast("array<long>").alias("source_sizes"))
    where = singles.union(none).withColumn("base", F.expr("if(size > 0, given div size, 0L)"))
    where = ws.save(where.withColumn("rest", F.col("given") - F.col("base") * F.col("size")), "quotas")
    rest = where.select("pattern", "rest")
    at = rest.select("pattern", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for length in (3, 6, 9):
        # keys are pattern and prefix, so a large source is dealt out by its prefixes
        inside = sized.groupBy("pattern", F.substring("o", 1, length - 3).alias("prefix"), F.substring("o", 1, length).alias("p")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("pattern").orderBy("p")) + F.col("before")
        passing = inside.join(at, ["pattern", "prefix"]).withColumn("upto", run).where("upto > rest")
        passing = passing.groupBy("pattern").agg(F.min_by(F.struct("p", (F.col("upto") - F.col("size")).alias("before")), "p").alias("x"))
        at = ws.save(passing.select("pattern", F.col("x.p").alias("prefix"), F.col("x.before").alias("before")).join(rest, "pattern").select("pattern", "rest", "prefix", "before"), "prefixes")
    last = sized.withColumn("prefix", F.substring("o", 1, 9)).join(at, ["pattern", "prefix"])
    last = _running(last).where("upto - size / 2 <= rest").groupBy("pattern").agg(F.max(F.struct("o", "size")).alias("last"))
    out = where.join(at.select("pattern", "prefix"), "pattern", "left").join(last, "pattern", "left")
    order, size = F.coalesce("last.o", "prefix", F.lit("~")).alias("last_order"), F.coalesce("last.size", F.lit(-1).cast("long")).alias("last_size")
    return ws.save(out.select("pattern", "size", "given", "base", order, size, "targets", "source_sizes"), "plan")


def _pattern(sources: Column) -> Column:
    """Distinct sources, sorted, a null last."""
    return F.array_distinct(F.sort_array(F.transform(sources, lambda s: s.cast("string")), asc=True))


def taken(docs: DataFrame, sources: Column, seed: str = SEED, copies: int = COPIES, ws: Workspace | None = None, name: str = "mix", **weighing) -> DataFrame:
    """docs with a further column, mix: a struct of size, copies and the pattern's row of plan()."""
    ws = ws or Workspace(docs.sparkSession, "mixing")
    sized = _sized(docs, sources, seed, ws)
    patterns = _patterns(sized)
    wide = len(patterns) > MOST_PATTERNS and sized.where("size(pattern) > 1").isEmpty()
    chosen = _wide(sized, copies, ws, **weighing) if wide else _planned(sized, patterns, copies, **weighing)
    names = docs.columns
    rows = docs.select(F.struct("*").alias("doc"), _pattern(sources).alias("_p"), n_words(F.col("text")).alias("_n"), _order(F.col("doc_id"), seed).alias("_o"))
    side = chosen.select(F.struct("*").alias("_c"))
    # beyond what may be broadcast, a merge join, which Spark can split at a large source
    side = side.hint("merge") if wide else F.broadcast(side)
    rows = rows.join(side, F.col("_p").eqNullSafe(F.col("_c.pattern")), "left")
    more = F.when((F.col("_o") < F.col("_c.last_order")) | ((F.col("_o") == F.col("_c.last_order")) & (F.col("_n") <= F.col("_c.last_size"))), 1).otherwise(0)
    mix = F.struct(F.col("_n").alias("size"), F.least(F.col("_c.base") + more, F.lit(copies)).alias("copies"), F.col("_c").alias("plan"))
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in names), mix.alias(name))


def mix(docs: DataFrame, sources: Column, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; those of size 0 go."""
    name = "mix"
    while name in docs.columns:
        name += "_"
    rows = taken(docs, sources, name=name, **options)
    times = F.when(F.col(name)["size"] > 0, F.col(name)["copies"]).otherwise(0).cast("int")
    # a document of no copies makes an empty array, and so no row
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w,
    1.5 * sum(source_size) OVER () AS total
  FROM sums),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k,
    total - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
  FROM weighed),
capped AS (SELECT *, coalesce(max(CASE WHEN remaining * w / behind > 2 * source_size THEN k END) OVER (), 0) AS last FROM ranked),
level AS (
  SELECT *, total - 2 * coalesce(sum(source_size) FILTER (WHERE k <= last) OVER (), 0) AS rest,
    sum(w) FILTER (WHERE k > last) OVER () AS free
  FROM capped),
quota AS (
  SELECT source, source_size, CAST(CASE WHEN k <= last THEN 2 * source_size ELSE CAST(rest AS DOUBLE) * w / free END AS DOUBLE) AS target
  FROM level),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS base FROM quota),
run AS (
  SELECT s.doc_id, s.size, q.source_size, q.target, q.base, CAST(floor(q.target) AS BIGINT) - q.base * q.source_size AS extra,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.size RANGE UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN split q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(base + CASE WHEN upto - size / 2 <= extra THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM run"""
