"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (runs of ASCII letters, digits and bytes beyond ASCII, A-Z in lower case) and the runs of
four and five bytes inside them, each hashed to one of ``SLOTS`` slots; a text is the set of its slots S, and

    z = b + sum of w_i over S + sum of <v_i, v_j> over the pairs i < j of S,        score = 1 / (1 + exp(-z)).

The pairs are what a sum of weights cannot say: a word that offends only next to another.  Only slots whose texts are more
often, or more rarely, toxic than chance has it take part, and proximal gradient steps set the weights of those that do
not help to zero: a long text is judged by what it says, not by its length.

The machine is fitted on at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` other labelled rows, the first by a hash of
their ids; every row is scored, over its whole text.  Null and empty texts have no terms and score 1 / (1 + exp(-b)).
Equal texts score the same; rows with a null id are scored and never learnt from; of label rows with one id the greatest
counts, of documents with one id the least text.  Without labelled rows of both classes the score is
(toxic + 0.5) / (labelled + 2) for all.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
THRESHOLD = 0.5
SLOTS, RANK = 1 << 20, 4
#: Slots of fewer sampled texts are not learnt, nor those within so many standard deviations of chance; the MOST furthest are.
LEAST_TEXTS, LEAST_Z, MOST = 3, 3.0, 8192
STEPS, BATCH, RATE, RATE_V = 1500, 256, 0.2, 0.05
#: What each step takes off a weight, and off the length of a slot's factors.
SHRINK_W, SHRINK_V = 3e-4, 2e-3

_U = np.uint64
_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[48:58] = _TERM_BYTE[97:123] = _TERM_BYTE[128:] = True


def term_slots(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, document row) of every word and every run of four and five bytes of a block, repeats included."""
    buf = C.lower_ascii(buf)
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _TERM_BYTE[buf]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] | (row[1:] != row[:-1])
    start = np.flatnonzero(begins)
    ends = inside[:n].copy()
    ends[:-1] &= ~inside[1:n] | (row[1:] != row[:-1])
    end = np.flatnonzero(ends) + 1
    sums = C.prefix_hash(buf)
    slots, rows = [C.range_hash(sums, start, end) >> _U(1)], [row[start]]
    length = end - start
    for k in (4, 5):
        own = length >= k
        count = length[own] - k + 1
        at = np.repeat(start[own] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(count.sum())
        slots.append(C.range_hash(sums, at, at + k))
        rows.append(row[at])
    return (np.concatenate(slots) % _U(SLOTS)).astype(np.int64), np.concatenate(rows)


def once(slot: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each slot of a row once, by rows."""
    both = np.unique(row * SLOTS + slot)
    return both % SLOTS, both // SLOTS


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Machine:
    """Bias b, weights w and factors v of the slots it has learnt; ``column`` leads from a slot to its place in them."""

    def __init__(self, texts: list[np.ndarray], toxic: np.ndarray, steps: int = STEPS):
        """texts: the distinct slots of each sampled text; toxic: 0 or 1 of each."""
        n, positive = len(texts), int(toxic.sum())
        base = (positive + 0.5) / (n + 2)
        self.b = float(np.log(base / (1 - base)))
        seen, bad = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        for t, y in zip(texts, toxic.tolist(), strict=True):  # text by text: its slots are distinct
            seen[t] += 1
            bad[t] += y
        share = positive / max(n, 1)
        z = np.abs(bad - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        learnt = np.flatnonzero((seen >= LEAST_TEXTS) & (z >= LEAST_Z))
        learnt = np.sort(learnt[np.argsort(-z[learnt], kind="stable")[:MOST]])
        column = np.full(SLOTS, -1, np.int32)
        column[learnt] = np.arange(len(learnt))
        self.w = np.zeros(len(learnt), np.float32)
        self.v = np.zeros((len(learnt), RANK), np.float32)
        if 0 < positive < n and len(learnt):
            places = [p[p >= 0] for p in (column[t] for t in texts)]
            cut = np.append(0, np.cumsum([len(p) for p in places]))
            self._fit(np.concatenate(places), cut, toxic.astype(np.float32), -(-steps * BATCH // n))
        kept = (self.w != 0) | (self.v != 0).any(1)
        self.column = np.full(SLOTS, -1, np.int32)
        self.column[learnt[kept]] = np.arange(kept.sum())
        self.w, self.v = self.w[kept], self.v[kept]

    def _fit(self, place: np.ndarray, cut: np.ndarray, toxic: np.ndarray, epochs: int) -> None:
        m, n = len(self.w), len(toxic)
        deal = np.random.default_rng(1)
        self.v = deal.normal(0, 0.1, (m, RANK)).astype(np.float32)
        grown_w, grown_v, grown_b = np.full(m, 1e-2, np.float32), np.full((m, RANK), 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = deal.permutation(n)
            for first in range(0, n, BATCH):
                rows = order[first : first + BATCH]
                count = cut[rows + 1] - cut[rows]
                at = np.repeat(cut[rows] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(count.sum())
                own, doc = place[at], np.repeat(np.arange(len(rows)), count)
                factors = self.v[own]
                sums = np.stack([np.bincount(doc, factors[:, f], minlength=len(rows)) for f in range(RANK)], 1)
                squares = np.bincount(doc, np.einsum("ij,ij->i", factors, factors), minlength=len(rows))
                z = self.b + np.bincount(doc, self.w[own], minlength=len(rows)) + ((sums * sums).sum(1) - squares) / 2
                error = (sigmoid(z) - toxic[rows]) / len(rows)
                each = error[doc]
                grad_w = np.bincount(own, each, minlength=m)
                touched = np.flatnonzero(np.bincount(own, minlength=m))
                grad_v = np.stack([np.bincount(own, each * (sums[doc, f] - factors[:, f]), minlength=m) for f in range(RANK)], 1)
                grown_b += float(error.sum()) ** 2
                self.b -= RATE * float(error.sum()) / grown_b**0.5
                grown_w[touched] += grad_w[touched] ** 2
                step = RATE / np.sqrt(grown_w[touched])
                w = self.w[touched] - step * grad_w[touched]
                self.w[touched] = np.sign(w) * np.maximum(np.abs(w) - step * SHRINK_W, 0)
                grown_v[touched] += grad_v[touched] ** 2
                step = RATE_V / np.sqrt(grown_v[touched])
                v = self.v[touched] - step * grad_v[touched]
                long = np.sqrt((v * v).sum(1, keepdims=True))
                self.v[touched] = v * np.maximum(1 - step.mean(1, keepdims=True) * SHRINK_V / np.maximum(long, 1e-12), 0)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        slot, row = term_slots(buf, off)
        known = self.column[slot] >= 0  # few are left, so only these are made distinct
        slot, row = once(slot[known], row[known])
        place = self.column[slot]
        z = self.b + np.bincount(row, self.w[place], minlength=n)
        for f in range(RANK):
            v = self.v[place, f].astype(np.float64)
            z += (np.bincount(row, v, minlength=n) ** 2 - np.bincount(row, v * v, minlength=n)) / 2
        return sigmoid(z)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Machine:
    """``learn`` (a condition on doc_id) says which rows may be learnt from."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn).groupBy(F.col("doc_id").cast("long").alias("chosen")).agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda y, n: said.where(F.col("toxic") == y).orderBy(F.xxhash64("chosen"), "chosen").limit(n)
    chosen = pick(1, toxic).unionByName(pick(0, clean))  # at most toxic + clean rows of two numbers
    own = docs.select(F.col("doc_id").cast("long").alias("chosen"), "text")
    texts = own.join(F.broadcast(chosen), "chosen").groupBy("chosen", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in C.blocks(batch.column(2)):
                slot, row = once(*term_slots(buf, off))
                cut = np.searchsorted(row, np.arange(j - i + 1))
                slots = [slot[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(slots, pa.binary())], names=["chosen", "toxic", "slots"])

    rows = texts.select("chosen", "toxic", "text").mapInArrow(run, "chosen long, toxic int, slots binary").orderBy("chosen").toArrow()
    return Machine([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("slots")], rows.column("toxic").to_numpy().astype(np.int64))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in C.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(machine.score(buf, off))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 bucket is fold[1] of fold[0] are never learnt from."""
    bucket = C.crc_bucket(F.col("doc_id"), fold[0])
    machine = fit(docs, labels, bucket != fold[1])
    held = F.coalesce(bucket == fold[1], F.lit(False))
    return scored(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
