"""Quality classifier by positive-unlabelled learning.

A linear model over the whole text - 20 statistics of its form, and how often its words, pairs of words and runs of four
bytes fall into each of HASHED slots of their hashes - minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss, from trusted positives and unlabelled web text.  The class prior is estimated first: a model of
positive against unlabelled text ranks both samples, and the prior is the least ratio of unlabelled to positive rows
above any threshold that leaves enough positives.

It is fitted on at most ``SAMPLE_P`` positives and ``SAMPLE_U`` unlabelled rows, the first by a hash of their ids; every
row is scored.  Null and empty texts have all statistics at zero and are scored like any other; very long texts are read whole.  Equal texts get equal
scores; rows with a null id are scored and never learnt from; of rows with one id the least text is learnt from.  Without any positive, every score is 0.5.  An empty table
gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SAMPLE_P, SAMPLE_U = 6000, 12000
THRESHOLD = 0.7

#: Byte classes whose shares are statistics: A-Z, a-z, digits, sentence marks, other ASCII marks, line feeds, other white space, beyond ASCII.
_CLASS = np.full(256, 7)
_CLASS[:128] = 4
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 3
_CLASS[10] = 5
_CLASS[[0x20, 9, 11, 12, 13]] = 6
N_FEATURES = 20
#: Slots of each kind of hashed run, and what is added to a text's number of runs, so that short texts weigh less.
HASHED, KINDS, SMOOTH = 512, 3, 20


def distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document; rows rise."""
    _, first = np.unique(C.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[first], minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES) statistics of a block of texts."""
    n, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * 8 + _CLASS[buf], minlength=8 * n).reshape(n, 8)[:, :8] / np.maximum(size, 1)[:, None]
    start, end, doc = C.word_spans(buf, off)
    words = np.bincount(doc, minlength=n)
    per_word = np.maximum(words, 1)
    h = C.word_hashes(buf, start, end)
    length = end - start
    kinds = np.zeros((len(buf) + 1, 3), np.int32)
    if len(buf):
        c = _CLASS[buf]
        np.cumsum(np.stack([(c == 4), (c == 0), (c == 1) | (c == 7)], 1), axis=0, out=kinds[1:])
    inside = kinds[end] - kinds[start]
    mean = lambda x: np.bincount(doc, x, minlength=n) / per_word
    g, at = C.gram_hashes(h, doc, 3)
    grams = np.bincount(doc[at], minlength=n)
    cuts = np.flatnonzero(buf == 10)
    lines = np.bincount(np.searchsorted(off[1:], cuts, "right"), minlength=n) + (size > 0)
    average = mean(length)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    repeated = 1 - distinct(g, doc[at], n) / np.maximum(grams, 1)
    marked, shouted = mean(inside[:, 0] > 0), mean((inside[:, 1] > 1) & (inside[:, 2] == 0))
    out = np.stack(
        [
            *share.T[:8],
            np.log1p(words) / 8,
            average / 10,
            np.abs(average - 5) / 10,
            mean(length > 15),
            marked,
            mean((inside[:, 1] == 0) & (inside[:, 2] == 0)),
            shouted,
            distinct(h, doc, n) / per_word,
            repeated,
            mean(same),
            np.log1p(lines) / 5,
            np.minimum(words / np.maximum(lines, 1), 100) / 100,
        ],
        1,
    )
    out[words == 0] = 0
    return out.astype(np.float32)


def hashed_runs(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slot, document row, 1 / smoothed number of runs of each document) of words, pairs of words and runs of four bytes."""
    n = len(off) - 1
    buf = C.lower_ascii(buf)
    start, end, doc = C.word_spans(buf, off)
    h = C.word_hashes(buf, start, end)
    g, at = C.gram_hashes(h, doc, 2)
    wide = buf.astype(np.uint32)
    four = (wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24) * np.uint32(0x9E3779B1) >> np.uint32(16) if len(buf) > 3 else wide[:0]
    row = np.repeat(np.arange(n), np.diff(off))
    inside = row[: len(four)] == row[3:] if len(four) else np.zeros(0, bool)
    out = []
    for k, (slot, own) in enumerate(((h, doc), (g, doc[at]), (four[inside], row[: len(four)][inside]))):
        out.append(((slot % slot.dtype.type(HASHED)).astype(np.int64) + k * HASHED, own, 1 / (np.bincount(own, minlength=n) + SMOOTH)))
    return out


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES + KINDS * HASHED): statistics and shares of slots."""
    n = len(off) - 1
    shares = np.zeros((n, KINDS * HASHED), np.float32)
    for slot, row, weight in hashed_runs(buf, off):
        np.add.at(shares.reshape(-1), row * (KINDS * HASHED) + slot, weight[row].astype(np.float32))
    return np.concatenate([statistics(buf, off), shares], 1)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features as 16-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in C.blocks(batch.column(1), 1 << 20):
                x = features(buf, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x binary")


# ---------------------------------------------------------------- learning
def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(p: np.ndarray, u: np.ndarray, least: float = 0.3) -> float:
    """Share of positives among u, by the least ratio of tails under a model of p against u fitted on every other row."""
    tp, tu = p[::2], u[::2]
    w = descend(lambda w: (-(1 - sigmoid(tp @ w)) @ tp / len(tp) + sigmoid(tu @ w) @ tu / len(tu)) / 2 + 1e-4 * w, p.shape[1], 300)
    sp, su = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0, 1 - least, 60))
    tail_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = 0.5 * np.sqrt(tail_u * (1 - tail_u) / len(su) + tail_p * (1 - tail_p) / len(sp))
    return float(np.clip(np.min((tail_u + slack) / tail_p), 0.05, 0.98))


class Model:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600):
        size = N_FEATURES + KINDS * HASHED
        n = len(positive) + len(unlabelled)
        self.centre, self.scale = np.zeros(size, np.float32), np.ones(size, np.float32)
        if n:  # in two sweeps over slices: the rows stay 16-bit floats
            slices = [(x, i) for x in (positive, unlabelled) for i in range(0, len(x), 1024)]
            mean = sum(x[i : i + 1024].sum(0, dtype=np.float64) for x, i in slices) / n
            spread = sum(((x[i : i + 1024] - mean) ** 2).sum(0) for x, i in slices) / n
            self.centre = mean.astype(np.float32)
            self.scale = (np.sqrt(spread) + np.repeat([1e-3, 1e-4], [N_FEATURES, KINDS * HASHED])).astype(np.float32)
        #: Slots weigh less at first and are held shorter than statistics: there are many of them.
        self.scale[N_FEATURES:] *= 8
        self.hold = np.repeat([1e-4, 3e-3, 0], [N_FEATURES, KINDS * HASHED, 1]).astype(np.float32)
        self.w = np.zeros(size + 1, np.float32)
        self.prior = 0.5
        if len(positive) > 1 and len(unlabelled) > 1:
            p, u = self._inputs(positive), self._inputs(unlabelled)
            form = np.r_[0:N_FEATURES, size]
            self.prior = estimated_prior(p[:, form].astype(float), u[:, form].astype(float))
            self.w = descend(lambda w: self._gradient(w.astype(np.float32), p, u), size + 1, steps).astype(np.float32)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.ones((len(x), x.shape[1] + 1), np.float32)
        z[:, :-1] = x
        z[:, :-1] -= self.centre
        z[:, :-1] /= self.scale
        z[:, :N_FEATURES] = np.clip(z[:, :N_FEATURES], -8, 8)
        return z

    def _gradient(self, w: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        plus = -(1 - sigmoid(zp)) @ p / len(p)  # of R_p(+)
        minus_p, minus_u = sigmoid(zp) @ p / len(p), sigmoid(zu) @ u / len(u)
        risk = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
        rest = minus_u - self.prior * minus_p
        return self.prior * plus + (rest if risk >= 0 else -0.1 * rest) + self.hold * w

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of the good class of each text of a block; slots are looked up in the weights and never laid out."""
        z = np.clip((statistics(buf, off) - self.centre[:N_FEATURES]) / self.scale[:N_FEATURES], -8, 8) @ self.w[:N_FEATURES] + self.w[-1]
        each = self.w[N_FEATURES:-1] / self.scale[N_FEATURES:]
        z = z.astype(np.float64) - float(self.centre[N_FEATURES:] @ each)
        for slot, row, weight in hashed_runs(buf, off):
            z += np.bincount(row, each[slot], minlength=len(z)) * weight
        return sigmoid(z)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_p: int = SAMPLE_P, sample_u: int = SAMPLE_U) -> Model:
    """``learn`` (a condition on doc_id) says which rows may be learnt from."""
    pick = lambda df, n: df.where(F.col("doc_id").isNotNull() & learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = pick(labels.where("quality = 1").select(F.col("doc_id").cast("long")).distinct(), sample_p).withColumn("p", F.lit(True))
    anything = pick(docs.select(F.col("doc_id").cast("long")).distinct(), sample_u).withColumn("p", F.lit(False))
    chosen = positive.unionByName(anything).groupBy("doc_id").agg(F.max("p").alias("p"), F.max(~F.col("p")).alias("u"))
    chosen = chosen.withColumnRenamed("doc_id", "chosen")  # at most sample_p + sample_u rows
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "text")
    one = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = featured(one).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).orderBy("doc_id").select("x", "p", "u").toArrow()
    x = np.concatenate([np.frombuffer(v.as_buffer(), np.float16)[None] for v in rows["x"]] or [np.zeros((0, N_FEATURES + KINDS * HASHED), np.float16)])
    p, u = (rows[c].to_numpy().astype(bool) for c in ("p", "u"))
    del rows
    return Model(x[p], x[u])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in C.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(buf, off))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 bucket is fold[1] of fold[0] are never learnt from."""
    bucket = C.crc_bucket(F.col("doc_id"), fold[0])
    model = fit(docs, labels, bucket != fold[1])
    held = F.coalesce(bucket == fold[1], F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
