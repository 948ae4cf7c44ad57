"""URL filter: longest-matching rules, and a Bloom filter cascade for listed names.

The cascade's first level encodes the listed keys. The second encodes the keys
of the corpus that are not listed but pass the first, the third those of the
first level that pass the second, and so on until a level lets nothing wrong
through. Over the key universe it was built on, walking the levels gives exact
membership, with no join: a level is a few bits a key, held as a literal.

All of it is DataFrame functions. Keys are split by hash into as many shards as
keep one level's filter within MOST_BITS; with one shard the test is an inline
expression, with more the rows take one pass per A_PASS shards, so neither the
driver nor an executor ever holds the filters of more.

Defined results: a url that is null or has no ``://`` has an empty host and
path, matches no rule and is allowed; repeated rows each get their result, as do
rows with a null page_id; urls of any length are read whole; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Bits of one level of one shard: a literal of at most 1 MB.
MOST_BITS = 1 << 23
#: Shards whose filters one pass over the rows carries.
A_PASS = 16

#: (action, host and path): fixed by the query's contract.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Names blocked with their subdomains where no rule fits.
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits, else nulls."""
    name = action = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        at, start = text.split("/", 1)[0], "/" + text.split("/", 1)[1]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name = F.when(fits, F.lit(text)).otherwise(name)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def suffixes(host: Column) -> Column:
    """The host and all its parent names: a.b.c gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    salt: int
    data: bytes

    def passes(self, key: Column) -> Column:
        """Whether the filter holds the key. Probes stop at the first bit that is off."""
        found, data = F.lit(True), F.lit(bytearray(self.data))  # one value in the plan, however many probes read it
        for at in reversed(positions(key, self)):
            byte = F.conv(F.hex(F.substring(data, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            on = F.call_function("getbit", byte.cast("bigint"), (at % 8).cast("int")) == 1
            found = F.when(on, found).otherwise(F.lit(False))
        return found


def positions(key: Column, level: Level) -> list[Column]:
    one, two = F.xxhash64(F.lit(level.salt), key), F.xxhash64(F.lit(~level.salt), key)
    step = F.pmod(two, F.lit(level.bits - 1)) + 1
    return [F.pmod(F.pmod(one, F.lit(level.bits)) + F.lit(i) * step, F.lit(level.bits)) for i in range(level.probes)]


def _fill(keys: DataFrame, level: Level) -> Level:
    """The level's filter with all keys of the DataFrame set; at most bits / 64 rows come to the driver."""
    at = F.explode(F.array(*positions(F.col("key"), level)))
    words = keys.select(at.alias("at")).groupBy((F.col("at") / 64).cast("long").alias("word"))
    rows = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("bits")).collect()
    data = bytearray((level.bits + 63) // 64 * 8)
    for r in rows:
        data[8 * r.word : 8 * r.word + 8] = (r.bits & (2**64 - 1)).to_bytes(8, "little")
    return Level(level.bits, level.probes, level.salt, bytes(data))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """Exact for the universe's keys."""
        said = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            said = F.when(self.levels[i].passes(key), said).otherwise(F.lit(i % 2 == 1))
        return said


def _shape(n: int, rate: float, salt: int) -> Level:
    probes = max(1, math.ceil(-math.log2(rate)))
    return Level(max(64, math.ceil(n * probes / math.log(2))), probes, salt, b"")


def shards_for(listed: int, others: int, most_bits: int = MOST_BITS) -> int:
    rate = min(0.5, max(listed, 1) / max(others, 1) / math.sqrt(2))
    return max(1, math.ceil(1.3 * _shape(max(listed, 1), rate, 0).bits / most_bits))


def build(ws: Workspace, keys: DataFrame) -> Cascade:
    """keys: key, listed (distinct, not null), the complete universe."""
    now = ws.save(keys, "keys")
    sizes = {r.listed: r.n for r in now.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    levels: list[Level] = []
    inside, n, others = True, sizes.get(True, 0), sizes.get(False, 0)
    while n:
        rate = min(0.5, n / max(others, 1) / math.sqrt(2)) if not levels else 0.5
        level = _fill(now.where(F.col("listed") == inside), _shape(n, rate, 1000 + len(levels)))
        levels.append(level)
        # what the next level must encode: keys of the other side that pass
        rest = ws.save(now.where((F.col("listed") == inside) | level.passes(F.col("key"))), "keys")
        ws.drop(now)
        now, inside = rest, not inside
        others, n = n, now.where(F.col("listed") == inside).count()
    ws.drop(now)
    return Cascade(tuple(levels))


def blocked(rows: DataFrame, names: Column, listed: DataFrame, ws: Workspace | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """rows with a boolean column ``listed``: whether any of the names (an array) is a key of listed."""
    ws = ws or Workspace(rows.sparkSession, "urls")
    universe = rows.select(names.alias("names")).distinct().select(F.explode("names").alias("key"))
    universe = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True).alias("listed")))
    universe = ws.save(universe.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    size = universe.agg(F.count_if("listed"), F.count("*")).first()
    shards = shards_for(size[0], size[1] - size[0], most_bits)
    shard = lambda key: F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))
    if shards == 1:
        cascade = build(ws, universe)
        ws.drop(universe)
        return rows.withColumn("listed", F.exists(names, lambda x: cascade.member(x)))
    out = rows.withColumn("listed", F.lit(False))
    for low in range(0, shards, A_PASS):
        cascades = [(s, build(ws, universe.where(shard(F.col("key")) == s))) for s in range(low, min(shards, low + A_PASS))]

        def member(x: Column) -> Column:
            found = F.lit(False)
            for s, cascade in cascades:
                found = F.when(shard(x) == s, cascade.member(x)).otherwise(found)
            return found

        hit = F.exists(names, member)
        out = ws.save(out.withColumn("listed", F.col("listed") | hit), "pass")
    ws.drop(universe)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, ws: Workspace | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, per row of pages. listed: key, names blocked with their subdomains."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = blocked(parts, suffixes(F.col("host")), listed, ws, most_bits)
    name, action = rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))


def _oracle() -> str:
    listed = ", ".join(f"'{x}'" for x in LISTED)
    cases_rule, cases_verdict = "", ""
    for what, text in sorted(RULES, key=lambda r: -len(r[1])):
        at, start = text.split("/", 1)[0], "/" + text.split("/", 1)[1]
        fits = f"(host = '{at}' OR suffix(host, '.{at}')) AND prefix(path, '{start}')"
        cases_rule += f" WHEN {fits} THEN '{text}'"
        cases_verdict += f" WHEN {fits} THEN '{what}'"
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '{_SPLIT}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '{_SPLIT}', 2) AS path
  FROM pages)
SELECT page_id, host, path, CASE{cases_rule} END AS rule,
  CASE{cases_verdict}
    WHEN EXISTS (SELECT 1 FROM (SELECT unnest([{listed}]) AS name) l WHERE parts.host = l.name OR suffix(parts.host, '.' || l.name)) THEN 'block'
    ELSE 'allow' END AS verdict
FROM parts"""


ORACLE = _oracle()
