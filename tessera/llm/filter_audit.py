"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document is the set of filters it fails.  Per part of the corpus, counts of these sets (2^n numbers, whatever the
number of documents) give the removal polynomial: the multilinear extension of "documents removed by a set of filters",

    R(x) = sum over sets M of count(M) * (1 - product over i in M of (1 - x_i)).

Its values at the corners of the cube are the documents removed by a set of filters, so differences of corners tell what
each step of an order removes; and the integral over t of its i-th partial derivative at (t, ..., t) is filter i's Shapley
value, taken in exact fractions and multiplied by n!, the number of orders.

Null texts are empty texts; a null part is the empty string; very long texts are read whole.  A document repeats another
when its text equals that of a smaller id anywhere in the table: rows with one id do not repeat each other, rows without
an id repeat nothing and have no labels.  A document is good or toxic if any of its label rows says so.  Repeated rows
count each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.quality_model import distinct

#: The filters of the query: too short, too repetitive, too many capitals, symbols, repeats.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|"]] = True
_MASKS = "doc_id long, part string, digest binary, mask int"
_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


# ---------------------------------------------------------------- which filters a document fails
def text_failures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sets (bits) of the first four filters that each text of a block fails."""
    n = len(off) - 1
    start, end, doc = C.word_spans(buf, off)
    words = np.bincount(doc, minlength=n)
    unlike = distinct(C.word_hashes(buf, start, end), doc, n)

    def inside(x: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x, out=upto[1:])
        return upto[off[1:]] - upto[off[:-1]]

    capitals, points = inside((buf >= 65) & (buf <= 90)), inside(buf & 0xC0 != 0x80)
    fails = [words < LEAST_WORDS, 100 * unlike < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, inside(_SYMBOL[buf]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: the set of filters that each row fails, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in C.blocks(batch.column(2)):
                raw = buf.tobytes()
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                own = [batch.column(c).slice(i, j - i) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array(text_failures(buf, off), pa.int32())], names=["doc_id", "part", "digest", "mask"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    rows = C.materialize(read.mapInArrow(run, _MASKS), "failures")
    # The least id of each text, counted before it moves; ids spread a text's copies over the join's tasks.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
    repeats = F.col("first").isNull() & F.col("doc_id").isNotNull()
    whole = F.col("mask") + F.when(repeats, 1 << 4).otherwise(0)
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", whole.alias("mask"))


# ---------------------------------------------------------------- the removal polynomial
def polynomial(counts: dict[int, int], n: int) -> list[int]:
    """Coefficients of R by the set of its variables (bits)."""
    out = [0] * (1 << n)
    for mask, count in counts.items():
        t = mask
        while t:  # every non-empty subset
            out[t] += count if t.bit_count() % 2 else -count
            t = (t - 1) & mask
    return out


def corner(r: list[int], chosen: int) -> int:
    """R where the chosen variables are 1 and the others 0."""
    total, t = 0, chosen
    while t:
        total += r[t]
        t = (t - 1) & chosen
    return total


def shapley(r: list[int], i: int) -> Fraction:
    """The integral over t from 0 to 1 of the i-th partial derivative of R at (t, ..., t)."""
    return sum((Fraction(a, t.bit_count()) for t, a in enumerate(r) if t >> i & 1), Fraction(0))


def orders(part: str, masks: list[dict], names: str) -> Iterator[tuple]:
    """The rows of one part; masks: mask, n, good, toxic."""
    n = len(names)
    every, total = (1 << n) - 1, sum(m["n"] for m in masks)
    r, good, toxic = (polynomial({m["mask"]: m[c] for m in masks}, n) for c in ("n", "good", "toxic"))
    corners = [[corner(p, s) for s in range(1 << n)] for p in (r, good, toxic)]
    gone, good_gone, toxic_gone = corners
    values = [shapley(r, i) * math.factorial(n) for i in range(n)]
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield (
                part,
                "".join(names[k] for k in order),
                step,
                total - gone[after],
                removed,
                gone[1 << i] - removed,
                gone[every] - gone[every ^ 1 << i],
                good_gone[after] - good_gone[before],
                toxic_gone[after] - toxic_gone[before],
                int(values[i]),
            )
            before = after


def interactions(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every part, order and step of masks (part, mask, good boolean, toxic boolean), one row a document there."""
    flag = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), flag("good"), flag("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2^n at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split()[0] for c in _AUDIT.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                found = zip(*orders(row["part"], row["masks"], names), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "step" else None) for c, v in zip(columns, found, strict=True)], names=columns)

    return parts.mapInArrow(run, _AUDIT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What filters A to E remove of each part, by order and step, with good and toxic documents lost and Shapley values."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    masks = failures(docs).join(said, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return interactions(masks)
