"""Benchmark decontamination by spaced-seed hashing.

Tokens are words with A-Z in lower case.  A text is contaminated by an item if some alignment without shifts has
``WINDOW`` consecutive tokens of which at most ``SUBS`` differ.  Fixed masks ignore selected positions: each mask's
kept tokens are hashed at every place of the items and of the texts, equal hashes are joined, and the windows around a
hit are counted token by token.  The three masks of six kept tokens leave no window of 12 tokens with two substitutions
unhit.  Items of fewer than 12 tokens must occur whole, with one substitution in six tokens at most, and without any
below six tokens.

Both sides of the join are tables: the items' seeds, and the seeds of texts that pass a Bloom filter of bounded size
(``FILTER_BITS`` at most; a benchmark that fills it only lets more rows into the join).  Neither the driver nor a task
holds the benchmark.  Texts that are equal are joined and verified once.  A pair of text and item is verified by the
surroundings of its hits: places whose surroundings are equal share one answer, and a place is done as soon as all words
around it are covered, so long stretches of one repeated word stay cheap.

Null and empty texts and items match nothing.  Very long texts are hashed whole; a pair's memory follows the longer of
the two.  Equal rows get equal answers (there are no ties), null ids are carried along, an empty table on either side
gives no match.  Columns other than doc_id, text and item_id are never read by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

WINDOW, SUBS = 12, 2
#: With six kept tokens each; together they hit every window of 12 with two substitutions (tests check it).
MASKS = ("11101011", "11010111", "1110010011")
#: Bits of the filter for each seed, hash functions, and most bits of all: 16 MB.
SEED_BITS, FILTER_HASHES, FILTER_BITS = 64, 3, 1 << 27
#: Hits that are counted at once.
HITS_AT_ONCE = 1 << 15

_U = np.uint64
#: Kept places by kind of seed: the masks, runs of three for items of 6 to 11 tokens, whole items of 1 to 5.
CARE = [np.flatnonzero([c == "1" for c in m]) for m in MASKS] + [np.arange(3)] + [np.arange(n) for n in range(1, 6)]
RUNS = len(MASKS)


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block of texts, and where each text's begin (with the end appended)."""
    buf = C.lower_ascii(buf)
    start, end, doc = C.word_spans(buf, off)
    return C.word_hashes(buf, start, end), np.searchsorted(doc, np.arange(len(off)))


def seeds(words: np.ndarray, first: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a kind's kept tokens at every start whose span stays in its text, and the starts."""
    care = CARE[kind]
    span = int(care[-1]) + 1
    m = len(words) - span + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    g = np.full(m, kind + 1, _U)
    for j, c in enumerate(care):
        g = (g + words[c : c + m]) * _U(0xB492B66FBE98F273 + 2 * j)
    inside = np.ones(m, bool)
    for back in range(1, span):
        edge = first[1:] - back
        inside[edge[(edge >= 0) & (edge < m)]] = False
    at = np.flatnonzero(inside)
    return C.mix(g[at]), at


def kinds_of(n: int) -> list[int]:
    """Kinds of seeds that find an item of n tokens."""
    return list(range(RUNS)) if n >= WINDOW else [RUNS] if n >= 6 else [RUNS + n] if n else []


# ---------------------------------------------------------------- one text against one item
class Item:
    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        self.width, self.allowed = min(n, WINDOW), SUBS if n >= WINDOW else n // 6
        self.tables = []
        for kind in kinds_of(n):
            h, at = seeds(words, np.array([0, n]), kind)
            order = np.argsort(h, kind="stable")
            self.tables.append((kind, h[order], at[order]))


def around(words: np.ndarray, at: np.ndarray, left: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, their inside) of the cells from ``left`` before each place on."""
    place = at[:, None] - left + np.arange(cells)
    return place, (place >= 0) & (place < len(words))


def covered(words: np.ndarray, item: Item) -> np.ndarray:
    """Which words of a text lie in a window that matches the item."""
    cover = np.zeros(len(words), bool)
    if len(words) < item.width or not item.width:
        return cover
    for kind, h, at in item.tables:
        span = int(CARE[kind][-1]) + 1
        g, pos = seeds(words, np.array([0, len(words)]), kind)
        lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
        hit = hi > lo
        lo, hi, pos = lo[hit], hi[hit], pos[hit]
        if not len(pos):
            continue
        # every window that holds the hit lies in these cells; equal cells mean equal answers
        left = item.width - span
        cells = 2 * item.width - span
        place, inside = around(words, pos, left, cells)
        look = np.where(inside, words[np.where(inside, place, 0)], _U(0))
        key = np.zeros(len(pos), _U)
        for k in range(cells):
            key = (key + look[:, k] + inside[:, k].astype(_U)) * _U(0x9E3779B97F4A7C15 + 2 * k)
        _, one, same = np.unique(C.mix(key), return_index=True, return_inverse=True)
        look, inside, lo, hi = look[one], inside[one], lo[one], hi[one]
        good = np.zeros(look.shape, bool)
        more = np.arange(len(one))
        step = 1
        while len(more):  # each place against its next few places of the item
            n = np.minimum(hi[more] - lo[more], step)
            which = np.repeat(more, n)
            mate = at[np.repeat(lo[more] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            for i in range(0, len(which), HITS_AT_ONCE):
                own, its = which[i : i + HITS_AT_ONCE], mate[i : i + HITS_AT_ONCE]
                there, both = around(item.words, its, left, cells)
                both &= inside[own]
                equal = both & (item.words[np.where(both, there, 0)] == look[own])
                sums = np.pad(np.cumsum(equal, 1), ((0, 0), (1, 0)))
                whole = np.pad(np.cumsum(both, 1), ((0, 0), (1, 0)))
                w = item.width
                fits = (whole[:, w:] - whole[:, :-w] == w) & (w - (sums[:, w:] - sums[:, :-w]) <= item.allowed)
                found = np.zeros(equal.shape, bool)
                for k in range(fits.shape[1]):
                    found[:, k : k + w] |= fits[:, k : k + 1]
                some = found.any(1)
                np.logical_or.at(good, own[some], found[some])
            lo[more] += n
            more = more[(lo[more] < hi[more]) & (good[more] != inside[more]).any(1)]
            step *= 2
        row, cell = np.nonzero(good[same])
        cover[pos[row] - left + cell] = True
    return cover


# ---------------------------------------------------------------- the join
def item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables (r, item_id, words) of the items and (h, r) of their distinct seeds."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, buf, off in C.blocks(batch.column(1)):
                words, first = words_of(buf, off)
                blobs, lists = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    blobs.append(words[a:b].tobytes())
                    found = [seeds(words[a:b], np.array([0, b - a]), k)[0] for k in kinds_of(int(b - a))]
                    lists.append(np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, lists)])
                h = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(r, r + j - i)), batch.column(0).slice(i, j - i), pa.array(blobs, pa.binary()), h], names=["r", "item_id", "words", "h"])
                r += j - i

    items = C.materialize(own.mapInArrow(run, "r long, item_id long, words binary, h array<long>"), "items")
    return items.select("r", "item_id", "words"), items.select(F.explode("h").alias("h"), "r")


def filter_places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(FILTER_HASHES):
        yield (C.mix(h + _U(0xA0761D6478BD642F * (k + 1) % (1 << 64))) & _U(bits - 1)).astype(np.int64)


def seed_filter(item_seeds: DataFrame) -> np.ndarray:
    """Bloom filter of the items' seeds, of at most FILTER_BITS bits; its slices are joined by Spark."""
    bits = 1 << 16
    n = item_seeds.count()
    while bits < min(FILTER_BITS, SEED_BITS * n):
        bits *= 2
    slices = max(1, bits >> 20)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for at in filter_places(batch.column(0).to_numpy().view(_U), bits):
                own[at] = True
        packed = np.packbits(own).reshape(slices, -1)
        some = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([packed[k].tobytes() for k in some], pa.binary())], names=["k", "data"])

    def join(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("data")])
        return pa.table({"k": table.column("k").slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((slices, bits // 8 // slices), np.uint8)
    for row in item_seeds.select("h").mapInArrow(mark, "k long, data binary").groupBy("k").applyInArrow(join, "k long, data binary").collect():  # FILTER_BITS / 8 bytes at most
        out[row["k"]] = np.frombuffer(bytes(row["data"]), np.uint8)
    return out.reshape(-1)


def text_key() -> list[Column]:
    """128 bits that stand for a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("x"), F.xxhash64(F.lit("second"), text).alias("y")]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(x, y, r, item_id, covered_words) of every distinct text and item row that match; x and y are text_key()."""
    items, item_seeds = item_tables(benchmark)
    known = seed_filter(item_seeds)
    bits = 8 * len(known)
    source = docs.select(*text_key(), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not known.any():
            return
        for batch in batches:
            for i, _, buf, off in C.blocks(batch.column(2)):
                words, first = words_of(buf, off)
                hashes, owners = [], []
                for kind in range(len(CARE)):
                    h, at = seeds(words, first, kind)
                    near = np.arange(len(h))
                    for place in filter_places(h, bits):
                        place = place[near]
                        near = near[known[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 > 0]
                    hashes.append(h[near])
                    owners.append(np.searchsorted(first, at[near], "right") - 1)
                h, own = np.concatenate(hashes), np.concatenate(owners)
                order = np.lexsort((h, own))
                h, own = h[order], own[order]
                new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))[: len(h)]
                h, own = h[new], own[new]
                rows, count = np.unique(own, return_counts=True)
                if len(rows):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(h.view(np.int64)))
                    blobs = pa.array([words[first[r] : first[r + 1]].tobytes() for r in rows], pa.binary())
                    at = pa.array(rows + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), blobs, lists], names=["x", "y", "words", "h"])

    texts = C.materialize(source.mapInArrow(scan, "x long, y long, words binary, h array<long>"), "texts_with_seeds", "lz4")
    met = texts.select("x", "y", F.explode("h").alias("h")).distinct().join(item_seeds, "h").select("x", "y", "r").distinct()
    pairs = C.materialize(met, "pairs_to_verify")
    wanted = texts.join(pairs.select("x", "y").distinct(), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.first("words").alias("words"))
    both = pairs.join(items.withColumnRenamed("words", "item_words"), "r").join(wanted, ["x", "y"]).select("x", "y", "r", "item_id", "words", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Item] = {}
            n = np.zeros(batch.num_rows, np.int64)
            for k, (r, words, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4), batch.column(5), strict=True)):
                if r not in seen:
                    seen[r] = Item(np.frombuffer(item.as_buffer(), _U))
                n[k] = covered(np.frombuffer(words.as_buffer(), _U), seen[r]).sum()
            keep = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in range(4)), pa.array(n[n > 0])], names=["x", "y", "r", "item_id", "covered_words"])

    return C.materialize(both.mapInArrow(verify, "x long, y long, r long, item_id long, covered_words long"), "contaminated")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered_words (distinct words of the text inside a matching window) of every contaminated pair."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key())
    return rows.join(contaminated(docs, benchmark), ["x", "y"]).select("doc_id", "item_id", "covered_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; all columns pass through."""
    gone = contaminated(docs, benchmark).select("x", "y").distinct()
    x, y = text_key()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, x, y).join(gone, ["x", "y"], "left_anti").select("row.*")
