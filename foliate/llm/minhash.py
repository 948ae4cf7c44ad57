"""MinHash near-duplicates by BagMinHash (Ertl, 2018).

A document is the multiset of its 5-word shingles. Each shingle owns Poisson
processes over discretised weight: one for the level interval [0, 1), one for
[1, 2), [2, 4), [4, 8) and so on, each with a rate equal to its length and a
random stream of its own. A point has a time, a register and a level, found by
descending the interval; it counts for a document only if the level lies below
the shingle's multiplicity there. A register keeps its earliest point, so two
documents agree in one with a probability of their weighted Jaccard
similarity. Points are generated up to a time by which every register is
expected to be filled; a document with one left empty is done over with twice
the time, which changes no register that was filled.

Signatures are banded. Documents that share a band's key are compared with the
key's central document, which avoids emitting all pairs of a group. Where a key
then still holds documents of several groups, the strays, which are those out of
its largest group, are compared with further centres of that group and at last
with all members of other groups, block by block. So none of the key's pairs
between different groups goes unseen, yet only links that join two groups come
out, and a group of any size costs work in proportion to it. Pairs whose
signatures agree enough are verified on the exact multiset overlap, and
connected components give groups.

Defined results: a null text and one without words is a group of its own;
texts of 1 to 4 words have one shingle, of all their words; copies of one text
with a word form one class, whose least doc_id stands for it; rows with the
same doc_id are one document and get the least of their groups, and where it
stands for several classes each text is compared as itself, told apart by its
version; rows with a null doc_id come back with nulls and kept true; very long
texts are blocks of their own and read whole; an empty table gives no rows.
Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textkit import U, Words, blocks, mix, multiset, shingles
from .workspace import Workspace

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: Members of a band key that meet in one block against block comparison, and rounds with other centres before that;
#: more of them lower what meets in blocks, at some twenty small jobs each.
MEET = 512
#: Words that the members of a block have on average at most.
MEET_WORDS = 500_000
ROUNDS = 1
#: Signatures that agree in less than this share of registers are not verified:
#: at a similarity of 0.8 that is 5 standard deviations below the mean.
AGREE = 0.65


def bag_signatures(h: np.ndarray, d: np.ndarray, w: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m registers (uint64) of the multisets (element h of document d, weight w)."""
    out = np.zeros((n_docs, m), np.uint64)
    total = np.bincount(d, weights=w, minlength=n_docs)
    todo = np.flatnonzero(total > 0)
    slack = 2.0
    while len(todo):
        limit = np.zeros(n_docs)
        limit[todo] = m * (np.log(m) + slack) / total[todo]
        pick = limit[d] > 0
        times = _registers(h[pick], d[pick], w[pick], limit, n_docs, m)
        full = np.isfinite(times[todo]).all(axis=1)
        done = todo[full]
        # the last bits may differ between processors' logarithms
        bits = times[done].view(np.uint64) + U(1 << 11)
        out[done] = mix(bits >> U(12))
        todo = todo[~full]
        slack = 2 * slack + np.log(m)
    return out


def _registers(h, d, w, limit, n_docs, m) -> np.ndarray:
    times = np.full(n_docs * m, np.inf)
    top = int(w.max()).bit_length() if len(w) else 0
    for level in range(top + 1):
        low = 0 if level == 0 else 1 << (level - 1)
        length = 1 if level == 0 else low
        on = slice(None) if level == 0 else np.flatnonzero(w > low)
        seed, doc, weight = mix(h[on] + U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)), d[on], w[on]
        end = limit[doc]
        t = np.zeros(len(seed))
        step = 0
        while len(seed):
            step += 1
            x = mix(seed + U(step * 0xD1342543DE82EF95 % 2**64))
            u = ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
            if step == 1:  # most processes have no point in time: spare them the logarithm
                live = np.flatnonzero(u > np.exp(-np.minimum(end * length, 700.0)) * (1 - 1e-9))
                seed, doc, weight, end, t, x, u = seed[live], doc[live], weight[live], end[live], t[live], x[live], u[live]
            t = t - np.log(u) / length
            live = np.flatnonzero(t <= end)
            seed, doc, weight, end, t, x = seed[live], doc[live], weight[live], end[live], t[live], x[live]
            y = mix(x ^ seed)
            register = ((y >> U(32)) * U(m)) >> U(32)
            at = doc * m + register.astype(np.int64)
            if length == 1:
                np.minimum.at(times, at, t)
            else:  # each bit of the low half takes one branch of the hierarchy
                descent = low + ((y & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length).astype(np.int64)
                inside = descent < weight
                np.minimum.at(times, at[inside], t[inside])
    return times.reshape(n_docs, m)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, k: int) -> Iterator[pa.RecordBatch]:
    m = bands * rows
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            words = Words(data, offsets)
            h, d, n = multiset(*shingles(words, k))
            s = bag_signatures(h, d, n, hi - lo, m)
            keys = np.zeros((hi - lo, bands), np.uint64)
            for r in range(rows):
                keys = mix(keys + s[:, r::rows] + U(r + 1))
            keys = mix(keys ^ np.arange(1, bands + 1, dtype=np.uint64)[None] * U(0x9E3779B97F4A7C15))
            low = (s & U(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(2).take(pa.array(np.arange(lo, hi), mask=words.counts == 0)),
                    pa.array(words.counts, pa.int64()),
                    pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * bands, pa.array(keys.view(np.int64).ravel())),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                ["doc_id", "digest", "n_words", "keys", "low"],
            )


def _digested(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest: 128 bits of the text's SHA-256, which stand for the text where equal texts are to meet."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text; null without words), n_words, keys (one per band), low (a byte per register)."""
    return _digested(docs).mapInArrow(lambda it: _sign(it, bands, rows, k), "doc_id long, digest binary, n_words long, keys array<long>, low binary")


def _alike(a: pd.Series, b: pd.Series, m: int) -> np.ndarray:
    x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, m)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, m)
    return ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _agreeing(frames: Iterator[pd.DataFrame], m: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            yield f.loc[_alike(f["low_a"], f["low_b"], m) >= AGREE, ["a", "va", "b", "vb"]]


def overlap(x: str | None, y: str | None, k: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the shingle multisets of two texts."""
    return float(_overlaps([x], [y], k)[0])


def _bags(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements (shingle, occurrence) of all texts as numbers, sorted within each, and offsets. Equal numbers are equal words."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(data, np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]))
    h, d, n = multiset(*shingles(words, k, exactly=True))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    elements = np.repeat(h, n) * (int(n.max(initial=0)) + 1) + nth
    return elements, np.concatenate([[0], np.cumsum(np.bincount(np.repeat(d, n), minlength=len(raw)))])


def _overlaps(x: list[str | None], y: list[str | None], k: int) -> np.ndarray:
    """overlap() of each x with the y at its place, on the words themselves."""
    elements, at = _bags([*x, *y], k)
    size, n = np.diff(at), len(x)
    pair = np.repeat(np.concatenate([np.arange(n), np.arange(n)]), size)
    number = np.unique(elements, return_inverse=True)[1] + pair * (len(elements) + 1)  # sorted on either side
    left, right = number[: at[n]], number[at[n] :]
    hit = np.searchsorted(left, right, "right") > np.searchsorted(left, right)
    both = np.bincount(pair[at[n] :], weights=hit, minlength=n)
    every = size[:n] + size[n:] - both
    return np.divide(both, every, out=np.zeros(n), where=every > 0)


def _verify(batches: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = {n: i for i, n in enumerate(batch.schema.names)}
        x, y = (batch.column(names[c]).to_pylist() for c in ("text_a", "text_b"))
        keep = pa.array(_overlaps(x, y, k) >= least - 1e-12, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(names[c]).filter(keep) for c in ("a", "b")], ["a", "b"])


def _meet(f: pd.DataFrame, m: int, k: int, least: float) -> pd.DataFrame:
    """Stray members of one key (left) against members of other groups (right): the links that join groups.

    A pair counts in the first key it shares, is held against its signatures and then its texts; once
    two groups are joined, pairs between them need no more looks. So at most one link a group comes out.
    """
    key, ids, label, stray = f["key"].iloc[0], f["doc_id"].to_numpy(), f["component"].to_numpy().copy(), f["stray"].to_numpy()
    low = np.frombuffer(b"".join(f["low"]), np.uint8).reshape(-1, m)
    keys = np.stack(f["keys"].to_numpy())
    band = int(np.flatnonzero(keys[0] == key)[0])
    elements, at = _bags(list(f["text"]), k)
    size = np.diff(at)
    left, right = f["on_left"].to_numpy(), np.flatnonzero(~f["on_left"].to_numpy())
    found = []
    for x in np.flatnonzero(left):
        c = right[label[right] != label[x]]
        c = c[~stray[c] | (ids[c] > ids[x])]  # two strays meet twice
        # no similarity is above the ratio of sizes
        c = c[np.minimum(size[c], size[x]) >= least * np.maximum(size[c], size[x]) - 1e-9]
        c = c[((low[x] == low[c]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= AGREE]
        c = c[~(keys[x, :band] == keys[c, :band]).any(axis=1)]
        if not len(c):
            continue
        own = elements[at[x] : at[x + 1]]
        n = size[c]
        start = np.cumsum(n) - n
        theirs = elements[np.arange(n.sum()) - np.repeat(start - at[c], n)]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(hit, start, dtype=np.int64)
        for y in c[both >= least * (size[x] + n - both) - 1e-9]:
            if label[y] != label[x]:
                found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                label[label == label[y]] = label[x]
    z = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": z[:, 0], "b": z[:, 1]})


class _Verifier:
    """Links among candidate pairs: signatures first, then texts."""

    def __init__(self, texts: DataFrame, m: int, k: int, similarity: float, ws: Workspace):
        self.low, self.texts = texts.select("doc_id", "version", "low"), texts.select("doc_id", "version", "text")
        self.m, self.k, self.similarity, self.ws = m, k, similarity, ws

    def links(self, one: DataFrame) -> DataFrame:
        """one: doc_id and version, twice, in any order of the two."""
        x, vx, y, vy = one.columns
        m, k, similarity = self.m, self.k, self.similarity
        first, second = F.struct(F.col(x).alias("a"), F.col(vx).alias("v")), F.struct(F.col(y).alias("a"), F.col(vy).alias("v"))
        pairs = one.where(F.col(x) != F.col(y)).select(F.least(first, second).alias("p"), F.greatest(first, second).alias("q"))
        pairs = pairs.select(F.col("p.a").alias("a"), F.col("p.v").alias("va"), F.col("q.a").alias("b"), F.col("q.v").alias("vb")).distinct()
        pairs = pairs.join(self.low.toDF("a", "va", "low_a"), ["a", "va"]).join(self.low.toDF("b", "vb", "low_b"), ["b", "vb"])
        pairs = self.ws.save(pairs.select("a", "va", "b", "vb", "low_a", "low_b").mapInPandas(lambda it: _agreeing(it, m), "a long, va int, b long, vb int"), "pairs")
        rows = pairs.join(self.texts.toDF("a", "va", "text_a"), ["a", "va"]).join(self.texts.toDF("b", "vb", "text_b"), ["b", "vb"])
        return self.ws.save(rows.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verify(it, k, similarity), "a long, b long"), "links")


def _open(banded: DataFrame, group: DataFrame, salt: int, ws: Workspace) -> DataFrame:
    """Members of keys that hold several groups: key, doc_id, version, n_words, component, stray (not of the key's largest
    group), centre and its version (a member of that group, another one for each key and salt)."""
    rows = banded.where("n > 2").select("key", "doc_id", "version", "n_words").join(group.toDF("doc_id", "component"), "doc_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
    any_member = F.min(F.struct(F.xxhash64(F.lit(salt), "key", "doc_id").alias("o"), F.col("doc_id").alias("d"), F.col("version").alias("v")))
    groups = rows.groupBy("key", "component").agg(F.count("*").alias("m"), any_member.alias("centre"))
    keys = groups.groupBy("key").agg(F.max(F.struct("m", "component", "centre")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    keys = ws.save(keys.select("key", F.col("top.component").alias("top"), F.col("top.centre.d").alias("centre"), F.col("top.centre.v").alias("centre_version")), "open-keys")
    return ws.save(rows.join(keys, "key").select("key", "doc_id", "version", "n_words", "component", (F.col("component") != F.col("top")).alias("stray"), "centre", "centre_version"), "open")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, ws: Workspace | None = None
) -> DataFrame:
    """doc_id, class_id (least doc_id with the same text), group_id (least doc_id
    reachable over links), kept (doc_id = group_id), one row per row of docs."""
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "minhash")
    m = bands * rows
    # every row's signature; one representative of each text goes on
    signed = ws.save(signatures(docs, bands, rows, k), "signatures")
    known = signed.where("doc_id is not null and digest is not null")
    # a table of its own: joins with it have a shuffle on either side, which Spark can split at a hot text
    classes = ws.save(known.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    members = ws.save(known.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id").distinct(), "members")
    reps = known.join(classes.withColumnRenamed("class_id", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    # version: 0, but for the further texts of a doc_id that stands for several
    several = classes.groupBy("class_id").agg(F.count("*").alias("texts")).where("texts > 1").select("class_id")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("digest")) - 1
    versions = classes.join(several, "class_id", "left_semi").select("digest", place.alias("version"))
    reps = reps.join(versions, "digest", "left").withColumn("version", F.coalesce("version", F.lit(0)))
    reps = ws.save(reps.select("doc_id", "version", "keys", "low", "digest", "n_words"), "representatives")
    sides = reps.select("doc_id", "version", "n_words", F.explode("keys").alias("key"))
    # the centre of a key is any member, another one for each key
    order = F.struct(F.xxhash64("key", "doc_id").alias("o"), F.col("doc_id").alias("centre"), F.col("version").alias("centre_version"))
    shared = sides.groupBy("key").agg(F.min(order).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", "c.centre", "c.centre_version", "n")
    banded = ws.save(sides.join(shared, "key"), "banded")
    # texts that share a key with another, told apart by their digests, with their signatures: what all later comparisons read
    ids = reps.drop("n_words").join(banded.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
    texts = _digested(docs).hint("merge").join(ids, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    texts = ws.save(texts.select("doc_id", "version", "keys", "low", "text"), "texts")
    verifier = _Verifier(texts, m, k, similarity, ws)
    links = verifier.links(banded.select("doc_id", "version", "centre", "centre_version"))
    group = components(ws, links)
    # strays of keys that still hold several groups meet other centres, of the key's largest group
    strays = None
    for salt in range(1, ROUNDS + 1):
        strays = _open(banded, group, salt, ws)
        if not strays.head(1):
            break
        more = verifier.links(strays.where("stray").select("doc_id", "version", "centre", "centre_version"))
        if not more.head(1):
            break
        links, strays = links.union(more), None
        group = components(ws, links)
    # and then all members of other groups, in blocks of strays against blocks of members; each meets its text once, before
    # it is dealt to blocks
    rows = (strays if strays is not None else _open(banded, group, 0, ws)).drop("centre", "centre_version")
    blocks_of = lambda n, words: F.ceil(F.greatest(n / MEET, words / MEET_WORDS)).cast("int")
    left_words = F.sum(F.when(F.col("stray"), F.col("n_words")).otherwise(0))
    count = rows.groupBy("key").agg(blocks_of(F.count_if("stray"), left_words).alias("nl"), blocks_of(F.count("*"), F.sum("n_words")).alias("nr"))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    place = lambda on_left, i, j: F.struct(F.lit(on_left).alias("on_left"), i.alias("i"), j.alias("j"))
    right = every("nl", lambda i: place(False, i, block("nr")))
    places = F.when(F.col("stray"), F.concat(every("nr", lambda j: place(True, block("nl"), j)), right)).otherwise(right)
    rows = rows.drop("n_words").join(ws.save(count, "blocks"), "key").join(texts, ["doc_id", "version"])
    meeting = rows.select("key", "doc_id", "component", "stray", "keys", "low", "text", F.inline(places))
    late = ws.save(meeting.groupBy("key", "i", "j").applyInPandas(lambda f: _meet(f, m, k, similarity), "a long, b long"), "late-links")
    if late.head(1):
        group = components(ws, links.union(late))
    ws.only(signed, members, group)
    found = (
        members.join(group.toDF("class_id", "component"), "class_id", "left")
        .groupBy("doc_id")
        .agg(F.min("class_id").alias("class_id"), F.min(F.coalesce("component", "class_id")).alias("group_id"))
    )
    return (
        signed.select("doc_id")
        .join(found, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("group_id", "doc_id").alias("group_id"),
            F.coalesce(F.col("group_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps; of rows with one doc_id that is kept, all stay."""
    judged = near_duplicates(docs, **options)
    gone = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE cut AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
bags AS (
  SELECT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS s, count(*) AS c FROM (SELECT DISTINCT doc_id, ws, unnest(range(greatest(1, len(ws) - 4))) AS i FROM cut WHERE len(ws) > 0) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n FROM bags GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * o >= 8 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node),
groups AS (SELECT node AS doc_id, min(root) AS group_id FROM reach GROUP BY node),
classes AS (SELECT text, min(doc_id) AS class_id FROM cut WHERE len(ws) > 0 GROUP BY text)
SELECT c.doc_id, coalesce(class_id, c.doc_id) AS class_id, group_id, group_id = c.doc_id AS kept
FROM cut c JOIN groups g ON g.doc_id = c.doc_id LEFT JOIN classes k ON k.text = c.text"""
