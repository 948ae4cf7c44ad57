"""Quality classifier by positive-unlabelled learning.

A logistic model is fitted to the non-negative unbiased risk (Kiryo et al.,
2017): with positives P, unlabelled texts U and class prior c,

    risk = c * E_P[loss(+)] + max(0, E_U[loss(-)] - c * E_P[loss(-)])

When the bracket turns negative the step goes against it, which keeps the model
from overfitting the positives. The prior is estimated from U and P alone: for
any region A, U(A) >= c * P(A), so the least ratio U(A) / P(A) over score
regions, each widened by its sampling error, bounds c from above (Blanchard,
Lee and Scott, 2010). Regions hold half of P or more and come from a first fit
with a provisional prior on one half of the positives; P(A) is taken on the
other half, and U(A) over all documents.

Features are shares of byte classes, repetition and line measures and hashed
byte trigrams of the whole text, worked out once and written as a table. Their
centre and scale are those of all documents. Of labelled rows at most FIT enter,
in hash order; as many unlabelled ones give a first model. From there REFINE
steps follow the risk over all unlabelled documents, whose gradient is a sum of
277 numbers a pass over the table.

Defined results: null, empty and wordless texts have all features 0 and get the
model's score for that; without positives, or without unlabelled texts, every
score is 0.5; rows with a null doc_id are scored, are not held out and belong to
no positive; repeated rows each get their result; very long texts are blocks of
their own and read whole; an empty table gives no rows; other columns, whatever
their names, are ignored by scores() and kept by keep_quality(). Equal rows of the
sampled ids enter the samples once, in all else they count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import SYMBOLS, duplicate_lines, per_text, repeated_words
from .textkit import Words, blocks, buffers, repeated
from .workspace import Workspace

FIT = 6_000
THRESHOLD = 0.3
#: Features enter centre and scale in steps of 1 / UNIT and up to MOST.
UNIT, MOST = 1 << 20, 100.0
TRIGRAMS = 256
WIDTH = 19 + TRIGRAMS
#: Steps over all documents that follow the first model, and their size.
REFINE, PACE = 8, 0.01
#: Words at which a text's trigram features count by half.
SHRINK = 40


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


CLASSES = [
    _class((65, 90)),
    _class((97, 122)),
    _class((48, 57)),
    _class((128, 255)),
    SYMBOLS,
    _class((33, 33), (63, 63)),
    _class((44, 44), (46, 46)),
    _class((9, 13), (32, 32)),
    _class((10, 10)),
    _class((124, 124)),
]
_HASH = np.random.default_rng(77).integers(0, 2**32, (3, 256), dtype=np.uint32)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of float32 features per text."""
    words = Words(data, offsets)
    h = words.numbers()
    n, size = np.maximum(words.counts, 1), np.maximum(np.diff(offsets), 1)
    shares = [per_text(c[data], offsets) / size for c in CLASSES]
    length = words.ends - words.starts
    same = repeated(h, words.doc)
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    upper = (data[words.starts] >= 65) & (data[words.starts] <= 90) if len(h) else np.zeros(0, bool)
    by_word = lambda x: np.bincount(words.doc, weights=x, minlength=words.n_docs) / n
    shares += [
        by_word(length) / 10,
        by_word(length > 20),
        by_word(~same),
        by_word(upper),
        by_word(stutter),
        repeated_words(words) / n,
        duplicate_lines(words) / np.maximum(per_text(data == 10, offsets), 1),
        np.log1p(words.counts) / 10,
        np.minimum(words.counts, 20) / 20,
    ]
    t = np.zeros((words.n_docs, TRIGRAMS))
    if len(data) > 2:
        g = _HASH[0][data[:-2]] + _HASH[1][data[1:-1]] + _HASH[2][data[2:]]
        g = (g * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)
        doc = np.repeat(np.arange(words.n_docs, dtype=np.int32) * np.int32(TRIGRAMS), np.diff(offsets))
        inside = doc[:-2] == doc[2:]
        doc = doc[:-2]
        doc += g.astype(np.int32)
        t = np.bincount(doc[inside], minlength=words.n_docs * TRIGRAMS).reshape(-1, TRIGRAMS)
    x = np.concatenate([np.stack(shares, 1), np.sqrt(t / size[:, None])], 1)
    x[words.counts == 0] = 0
    return x.astype(np.float32)


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def nonnegative_risk(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part before clipping) of the risk, from the outputs for P and U."""
    return prior * _loss(p).mean(), _loss(-u).mean() - prior * _loss(-p).mean()


def _fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int, decay: float) -> tuple[np.ndarray, float]:
    w, b = np.zeros(p.shape[1]), 0.0
    m = v = np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        gp, gn = -prior * _sigmoid(-zp) / len(p), -prior * _sigmoid(zp) / len(p)
        gu = _sigmoid(zu) / len(u)
        if nonnegative_risk(zp, zu, prior)[1] >= 0:
            dp, du = gp + gn, gu
        else:  # climb back: the negative part may not go below zero
            dp, du = -gn, -gu
        g = np.concatenate([p.T @ dp + u.T @ du + decay * w, [dp.sum() + du.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _cuts(p: np.ndarray) -> np.ndarray:
    """Scores at which regions begin that hold half of the positives or more."""
    return np.quantile(p, np.linspace(0.01, 0.5, 50))


def _shares(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (z[None] >= cuts[:, None]).mean(1)


def estimate_prior(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> float:
    """Upper bound of the share of positives in U from the shares of n_p positives and n_u unlabelled texts in the same regions."""
    slack_p, slack_u = np.sqrt(in_p * (1 - in_p) / n_p), np.sqrt(in_u * (1 - in_u) / n_u)
    ratio = (in_u + slack_u) / np.maximum(in_p - slack_p, 1e-3)
    return float(np.clip(ratio.min(), 0.05, 0.95))


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features; trigram shares of short texts, which are noise, are drawn towards the centre."""
    z = np.clip((x - centre) / scale, -8, 8)
    if x.shape[1] > TRIGRAMS:
        n = np.expm1(10 * x[:, -TRIGRAMS - 2].astype(np.float64))
        z[:, -TRIGRAMS:] *= (n / (n + SHRINK))[:, None]
    return z


class Model:
    def __init__(self, centre, scale, w, b, prior):
        self.centre, self.scale, self.w, self.b, self.prior = centre, scale, w, b, prior

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.centre, self.scale) @ self.w + self.b

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(_sigmoid(self.raw(x)), 9)


def _refined(model: Model, p: np.ndarray, gradient: Callable, decay: float) -> Model:
    """model after REFINE more steps that follow the risk over all unlabelled documents; the mean of the last half of them.

    p: standardised positives; gradient(model): mean over all unlabelled documents of the loss as negatives, and of its
    slope by each weight and the bias.
    """
    p = np.concatenate([p, np.ones((len(p), 1))], 1)
    now, kept = np.append(model.w, model.b), []
    m = v = np.zeros(len(now))
    for step in range(1, REFINE + 1):
        loss, gu = gradient(Model(model.centre, model.scale, now[:-1], now[-1], model.prior))
        z = p @ now
        gp, gn = (-model.prior * p.T @ _sigmoid(x) / len(p) for x in (-z, z))
        rising = loss >= model.prior * _loss(-z).mean()
        g = (gp + gn + gu if rising else -gn - gu) + decay * np.append(now[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        now = now - PACE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step > REFINE // 2:
            kept.append(now)
    now = np.mean(kept, axis=0)
    return Model(model.centre, model.scale, now[:-1], now[-1], model.prior)


def train(p: np.ndarray, u: np.ndarray, centre=None, scale=None, shares: Callable | None = None, gradient: Callable | None = None, steps: int = 400, decay: float = 1e-3) -> Model:
    """A model from features of positives and of unlabelled texts.

    Where the latter are a sample: centre and scale of all, shares(model, cuts), which gives the share of all in each
    region and their number, and gradient(model), see _refined().
    """
    if not len(p) or not len(u):
        return Model(np.zeros(p.shape[1]), np.ones(p.shape[1]), np.zeros(p.shape[1]), 0.0, 0.5)
    if centre is None:
        centre, scale = u.mean(0, dtype=np.float64), u.std(0, dtype=np.float64) + 1e-3
    p, u = (_standard(x, centre, scale) for x in (p, u))
    w, b = _fit(p[::2], u[::2], 0.5, steps // 2, decay)
    prior = 0.5
    if min(len(p), len(u)) > 1:
        z = p[1::2] @ w + b
        cuts = _cuts(z)
        in_u, n = shares(Model(centre, scale, w, b, 0.5), cuts) if shares else (_shares(u[1::2] @ w + b, cuts), len(u[1::2]))
        prior = estimate_prior(_shares(z, cuts), len(z), in_u, n)
    w, b = _fit(p, u, prior, steps, decay)
    model = Model(centre, scale, w, b, prior)
    return _refined(model, p, gradient, decay) if gradient else model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            x = features(data, offsets)
            rows = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * 4 * WIDTH), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), rows.cast(pa.binary())], ["doc_id", "x"])


def featured(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """doc_id and x (the features' bytes) of every row, as a table that is written once."""
    ws = ws or Workspace(docs.sparkSession, "quality")
    return ws.save(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_featured, "doc_id long, x binary"), "features")


def _rows(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.float32).reshape(-1, WIDTH)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield _rows(batch.column(0))


def _totals(values: np.ndarray) -> pa.RecordBatch:
    at = np.arange(values.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *map(pa.array, values)], ["i", *"xyz"[: len(values)]])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _features(batches):
        x = np.minimum(x.astype(np.float64), MOST)
        here = np.stack([np.rint(x * UNIT).astype(np.int64).sum(0), np.rint(x * x * UNIT).astype(np.int64).sum(0), np.full(x.shape[1], len(x))])
        total = here if total is None else total + here
    if total is not None:
        yield _totals(total)


def _regions(batches: Iterator[pa.RecordBatch], model: Model, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, len(cuts)), np.int64)
    for x in _features(batches):
        z = model.raw(x)
        total += np.stack([(z[None] >= cuts[:, None]).sum(1), np.full(len(cuts), len(z))])
    yield _totals(total)


def _slopes(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, WIDTH + 2), np.int64)
    for x in _features(batches):
        z = _standard(x, model.centre, model.scale)
        out = z @ model.w + model.b
        slope = _sigmoid(out)
        here = [np.rint(slope[:, None] * z * UNIT).astype(np.int64).sum(0), [np.rint(v * UNIT).astype(np.int64).sum() for v in (slope, _loss(-out))]]
        total += np.stack([np.concatenate(here), np.full(WIDTH + 2, len(x))])
    yield _totals(total)


def _added(texts: DataFrame, function, names: str) -> np.ndarray:
    """The partitions' totals, added up: a row for each name. Whole numbers, so the order does not matter."""
    sums = [F.sum(F.col(n).cast("decimal(38,0)")).cast("double").alias(n) for n in names]
    rows = texts.mapInArrow(function, "i int, " + ", ".join(f"{n} long" for n in names)).groupBy("i").agg(*sums).orderBy("i").collect()
    return np.array([[r[n] for n in names] for r in rows]).T


def fit(docs: DataFrame, positives: DataFrame, most: int = FIT) -> Model:
    """A model of docs (doc_id, text) and positives (doc_id of trusted texts), of which at most most rows enter."""
    return fit_features(featured(docs), positives, most)


def fit_features(rows: DataFrame, positives: DataFrame, most: int = FIT) -> Model:
    """fit() from the table that featured() gives."""
    ids = positives.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    other = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(most)

    def sample(of: DataFrame) -> np.ndarray:
        # equal rows of an id count once, and rows are bounded as ids are; in one order, however rows arrive
        got = rows.join(F.broadcast(of), "doc_id").select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(most).toArrow()
        return _rows(got.column("x")) if len(got) else np.zeros((0, WIDTH), np.float32)

    p, u = sample(ids), sample(other)
    if not len(p) or not len(u):
        return train(p, u)
    texts = rows.select("x")
    total, squares, n = _added(texts, _sums, "xyz")
    centre = total / n / UNIT
    scale = np.sqrt(np.maximum(squares / n / UNIT - centre**2, 0)) + 1e-3

    def shares(model: Model, cuts: np.ndarray) -> tuple[np.ndarray, int]:
        inside, n = _added(texts, lambda it: _regions(it, model, cuts), "xy")
        return inside / n, int(n[0])

    def gradient(model: Model) -> tuple[float, np.ndarray]:
        sums, n = _added(texts, lambda it: _slopes(it, model), "xy")
        mean = sums / n / UNIT
        return float(mean[-1]), mean[:-1]

    return train(p, u, centre, scale, shares, gradient)


def _score(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            x = features(data, offsets)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold), per row of docs."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _score(it, model, threshold), "doc_id long, score double, predicted int"
    )


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = model.score(_rows(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])


def score_features(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """scores() from the table that featured() gives."""
    return rows.select("doc_id", "x").mapInArrow(lambda it: _score_rows(it, model, threshold), "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """The rows that no label is learnt from. A null id has no label and is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _filter(batches: Iterator[pa.RecordBatch], model: Model, threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for lo, hi, data, offsets in blocks(batch.column(at)):
            x = features(data, offsets)
            keep.append(model.score(x) >= threshold)
        yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns, in one scan."""
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _filter(it, model, threshold, at), docs.schema)
