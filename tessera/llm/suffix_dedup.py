"""Exact substring deduplication: distributed prefix doubling over thinned positions.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.  Prefix
doubling names positions by ranks of growing prefixes: a rank and the rank further on make a pair, Spark deals and sorts
the pairs, equal pairs get one new rank, and positions whose rank is unique leave.  Here the ranks grow over ``LENGTHS``
= 20, 35 and 50 bytes, and the first one is a fingerprint instead of four rounds from single bytes.

Of all positions only the anchor of each string takes part in the first rounds: the least 20-byte rank inside the
string, leftmost of equals.  Equal strings have it at the same place, so no match is lost; about one position in fifteen
is an anchor.

1. Rank of 20 bytes.  Anchors whose rank occurs in one document alone leave.
2. An anchor stands for a run of strings.  Its rank is paired with the rank of all bytes that the run covers: of runs
   equal in both, those in later documents are repeats as a whole, whatever they hold, and only the first goes on.
3. Rank of 35 bytes, of the anchor on or up to the anchor's end: (rank 20 at p, rank 20 at p + 15).  A string of 50
   bytes around an anchor holds one of the two.  Runs whose pair occurs in one document alone leave.
4. Rank of 50 bytes of the strings still there: (rank 35 at p, rank 35 at p + 15).  Strings whose rank starts in an
   earlier document are repeats.

Ranks are named by fingerprints of 128 bits (round 1: 64, where a false equality costs work but no byte), so nothing but
a verdict of one byte travels back.  Texts lie in compressed blocks; a block sends the smallest and the greatest doc_id
of a rank, so a string that a third of the documents hold is met once or twice a block, never once a document.  Parts
are dealt by a mixed hash of the whole rank and settled in pieces of bounded size.

Null and empty texts, and texts below LENGTH bytes, lose nothing.  Very long texts are ranked in overlapping pieces and
are a block of their own.  Matches are between different ids: rows of one id are not compared, equal rows get equal
answers, and rows with a null id neither lose bytes nor make others lose any.  An empty table gives an empty result.
Columns other than doc_id and text are not read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Bytes that ranks cover, round by round; each step is at most the length before it.
LENGTHS = (20, 35, 50)
GRAM, STEP, LENGTH = LENGTHS[0], LENGTHS[1] - LENGTHS[0], LENGTHS[2]
BLOCK_TEXT, BLOCK_DOCS = 2 << 20, 60_000
#: Longer texts are ranked in pieces that overlap by LENGTH - 1 bytes.
PIECE = 256 << 10
#: Entries of a part that are sorted at once.
SETTLED_AT_ONCE = 2_000_000

_U = np.uint64
_PLACE_BITS = _U(40)
#: Verdicts on an entry: its rank occurs in several documents; in one with a smaller id.
SHARED, LATER = 1, 2


# ---------------------------------------------------------------- blocks of text
def string_anchors(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string start, anchor, last string start) of each run of strings with one anchor; documents start at cuts."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    q = np.arange(len(buf) - GRAM + 1)
    least = (C.range_hash(C.prefix_hash(buf), q, q + GRAM) >> _PLACE_BITS << _PLACE_BITS) | q.astype(_U)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    at = (least & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64)
    fits = np.ones(n, bool)  # strings that cross into the next document do not exist
    for back in range(1, LENGTH):
        edge = cuts[1:] - LENGTH + back
        fits[edge[(edge >= 0) & (edge < n)]] = False
    p = np.flatnonzero(fits)
    own = at[p]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1))) if len(p) else p
    return p[first], own[first], p[np.append(first[1:], len(p)) - 1] if len(p) else p


def pieces(off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, document starts and end inside): stretches of a buffer, cut so that every string is in exactly one."""
    for i, j in C.sub_blocks(off, PIECE):
        a, b = int(off[i]), int(off[j])
        if b - a <= PIECE:
            yield a, b, off[i : j + 1] - a
        else:  # one long document
            for c in range(a, b, PIECE):
                e = min(b, c + PIECE + LENGTH - 1)
                yield c, e, np.array([0, e - c])
                if e == b:
                    break


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, known, sizes, text, runs): documents in compressed blocks with their anchors; written once, so blocks stay what they are."""
    names = ["block", "ids", "known", "sizes", "text", "runs"]

    def packed(block: int, held: list[tuple]) -> pa.RecordBatch:
        ids, known, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
        text = b"".join(x[3] for x in held)
        off, buf = np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(text, np.uint8)
        found = [[x + a for x in string_anchors(buf[a:b], cuts)] for a, b, cuts in pieces(off)]
        lo, at, hi = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in range(3))
        gap = np.diff(np.append(-1, hi))[: len(lo)] - (hi - lo + 1)  # strings that no run holds before each
        squeeze = zstandard.ZstdCompressor(5).compress
        blobs = (ids.tobytes(), known.tobytes(), sizes.tobytes(), squeeze(text), squeeze(C.pack(gap.astype(np.int64), (at - lo).astype(np.uint8), (hi - lo).astype(np.uint8))))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = n = 0
        for batch in batches:
            ids = batch.column(0)
            known = np.array(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            for lo, hi, buf, off in C.blocks(batch.column(1), BLOCK_TEXT):
                for i in range(lo, hi, BLOCK_DOCS):
                    j = min(hi, i + BLOCK_DOCS)
                    own = off[i - lo : j - lo + 1]
                    if held and (n + j - i > BLOCK_DOCS or size + own[-1] - own[0] > BLOCK_TEXT):
                        yield packed(block, held)
                        held.clear()
                        block, size, n = block + 1, 0, 0
                    held.append((ids[i:j], known[i:j].astype(np.uint8), np.diff(own), buf[own[0] : own[-1]].tobytes()))
                    size, n = size + int(own[-1] - own[0]), n + j - i
        if held:
            yield packed(block, held)

    # bucketed by block: all passes over the texts read them in place, without another shuffle
    schema = "block long, " + ", ".join(f"{n} binary" for n in names[1:])
    blocks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    return C.bucketed(blocks, "text_blocks", "block", C.buckets_for(docs, 8), "none")


class Block:
    """Texts of one block, and its runs of strings: ``lo`` to ``hi`` start at most LENGTH - GRAM before their anchor ``at``."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, text: bytes, runs: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.known = np.frombuffer(known, np.uint8).astype(bool)
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(self.off[-1]))), np.uint8)
        gap, back, more = C.unpack(zstandard.ZstdDecompressor().decompress(runs, max_output_size=10 * len(self.buf) + 1), np.int64, np.uint8, np.uint8)
        self.lo = np.cumsum(gap + more + 1) - more - 1
        self.at, self.hi = self.lo + back, self.lo + more
        self.row = np.searchsorted(self.off[1:], self.lo, "right")
        own = self.known[self.row]
        self.lo, self.at, self.hi, self.row = (x[own] for x in (self.lo, self.at, self.hi, self.row))

    def ranks(self, start: np.ndarray, size) -> np.ndarray:
        """Fingerprints of ``size`` bytes (a number, or one for each) from the given, rising places on."""
        out = np.zeros(len(start), _U)
        end = start + size
        for a in range(0, len(self.buf), PIECE):
            i, j = np.searchsorted(start, (a, a + PIECE))
            if j > i:
                s = C.prefix_hash(self.buf[a : int(end[i:j].max())])
                out[i:j] = C.range_hash(s, start[i:j] - a, end[i:j] - a)
        return out


class Round:
    """The ranks (k1, k2) of one round in a block, as classes sorted by a mixed key; what is sent, and what the answer says."""

    def __init__(self, ids: np.ndarray, k1: np.ndarray, k2: np.ndarray | None):
        self.ids = ids
        key = C.mix(k1 if k2 is None else k1 + k2 * _U(0x9E3779B97F4A7C15))  # for a given k1 one-to-one in k2
        order = np.lexsort((ids, k1, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (k1[order][1:] != k1[order][:-1])) if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order)) - 1 if len(first) else first
        self.cls = np.empty(len(order), np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.least = ids[order[first]]
        several = ids[order[last]] > self.least
        # entries: the smallest id of a class and, where it differs, the greatest
        n = 1 + several
        self.entry = np.cumsum(n) - n
        pick = np.repeat(order[first], n)
        pick[self.entry[several] + 1] = order[last[several]]
        self.key, self.k1, self.sent = key[pick], k1[pick], ids[pick]

    def packed(self, parts: int) -> tuple[np.ndarray, list[bytes]]:
        own, cut = C.part_cuts(self.key, parts)
        return own, [C.pack(self.key[i:j], self.k1[i:j], self.sent[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def answered(self, parts: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(its rank occurs in several documents, in one with a smaller id) of every item."""
        own, cut = C.part_cuts(self.key, parts)
        state = np.zeros(len(self.key), np.uint8)
        for p, i, j in zip(own.tolist(), cut[:-1], cut[1:], strict=True):
            if p in answers:
                state[i:j] = np.frombuffer(answers[p], np.uint8)
        if not len(self.cls):
            return np.zeros(0, bool), np.zeros(0, bool)
        mine = state[self.entry[self.cls]]
        return mine & SHARED > 0, (mine & LATER > 0) | (self.ids > self.least[self.cls])


def settle(table: pa.Table) -> pa.Table:
    """Verdicts on the entries of one part, in their own order: (block, part, states); rows without any verdict are left out."""
    rows = [len(d) // 24 for d in (x.as_buffer() for x in table.column("data"))]
    states = [np.zeros(n, np.uint8) for n in rows]
    turns = 1 + sum(rows) // SETTLED_AT_ONCE
    bounds = None
    for turn in range(turns):
        keys, firsts, ids, spans = [], [], [], []
        for x in table.column("data"):
            key, k1, own = C.unpack(x.as_buffer(), _U, _U, np.int64)
            if turns == 1:
                i, j = 0, len(key)
            else:  # a part is a range of keys: its turns are equal shares of that range
                if bounds is None:
                    ends = [C.unpack(y.as_buffer(), _U, _U, np.int64)[0][[0, -1]] for y in table.column("data")]
                    low, high = int(min(e[0] for e in ends)), int(max(e[1] for e in ends)) + 1
                    bounds = np.array([low + (high - low) * t // turns for t in range(turns + 1)][:-1], _U)
                i = 0 if turn == 0 else int(np.searchsorted(key, bounds[turn]))
                j = len(key) if turn == turns - 1 else int(np.searchsorted(key, bounds[turn + 1]))
            spans.append((i, j))
            keys.append(key[i:j])
            firsts.append(k1[i:j])
            ids.append(own[i:j])
        key, k1, own = np.concatenate(keys), np.concatenate(firsts), np.concatenate(ids)
        if not len(key):
            continue
        order = np.lexsort((own, k1, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (k1[order][1:] != k1[order][:-1]))
        first = np.flatnonzero(new)
        cls = np.cumsum(new) - 1
        least, most = own[order[first]], own[order[np.append(first[1:], len(order)) - 1]]
        state = np.zeros(len(key), np.uint8)
        state[order] = (least < most)[cls] * SHARED + (own[order] > least[cls]) * LATER
        at = 0
        for s, (i, j) in zip(states, spans, strict=True):
            s[i:j] = state[at : at + j - i]
            at += j - i
    keep = [i for i, s in enumerate(states) if s.any()]
    some = table.select(["block", "part"]).take(pa.array(keep, pa.int64()))
    return some.append_column("states", pa.array([states[i].tobytes() for i in keep], pa.binary()))


# ---------------------------------------------------------------- the rounds
class Doubling:
    """A block's way through the rounds, as far as there are answers."""

    def __init__(self, block: Block, answers: list[dict[int, bytes]], parts: int):
        self.block, self.parts = block, parts
        self.removed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.round: Round | None = None
        steps = self._steps()
        next(steps)
        for answer in answers:
            self._answer = answer
            next(steps, None)

    def _steps(self) -> Iterator[None]:
        b, parts = self.block, self.parts
        ids = b.ids[b.row]
        gram = b.ranks(b.at, GRAM)
        self.round = Round(ids, gram, None)
        yield
        shared, _ = self.round.answered(parts, self._answer)
        row, ids, gram, lo, at, hi = (x[shared] for x in (b.row, ids, gram, b.lo, b.at, b.hi))
        # the runs as wholes, and where their anchor lies in them
        self.round = Round(ids, gram, C.mix(b.ranks(lo, hi + LENGTH - lo) + (at - lo).astype(_U)))
        yield
        _, later = self.round.answered(parts, self._answer)
        self.removed.append((row[later], lo[later], hi[later] + LENGTH))
        row, ids, gram, lo, at, hi = (x[~later] for x in (row, ids, gram, lo, at, hi))
        # a string that starts STEP or more before its anchor holds the 35 bytes that end with it, any other those that begin with it
        back, on = lo <= at - STEP, hi > at - STEP
        from_ = np.concatenate([lo[back], np.maximum(lo, at - STEP + 1)[on]])
        upto = np.concatenate([np.minimum(hi, at - STEP)[back], hi[on]])
        row, ids = np.concatenate([row[back], row[on]]), np.concatenate([ids[back], ids[on]])
        self.round = Round(ids, np.concatenate([b.ranks(at[back] - STEP, GRAM), gram[on]]), np.concatenate([gram[back], b.ranks(at[on] + STEP, GRAM)]))
        yield
        shared, _ = self.round.answered(parts, self._answer)
        order = np.flatnonzero(shared)[np.argsort(from_[shared], kind="stable")]
        n = (upto - from_ + 1)[order]
        at = np.repeat(from_[order] - np.cumsum(n) + n, n) + np.arange(n.sum())
        row, ids = np.repeat(row[order], n), np.repeat(ids[order], n)
        r = [b.ranks(at + k * STEP, GRAM) for k in range(3)]
        halves = [C.mix(x + y * _U(0xC2B2AE3D27D4EB4F)) for x, y in ((r[0], r[1]), (r[1], r[2]))]  # the two ranks of 35 bytes
        self.round = Round(ids, *halves)
        yield
        _, later = self.round.answered(parts, self._answer)
        self.removed.append((row[later], at[later], at[later] + LENGTH))


ROUNDS = 4


def blocks_of(table: pa.Table | pa.RecordBatch) -> Iterator[Block]:
    for i in range(table.num_rows):
        yield Block(*(table.column(c)[i].as_buffer() for c in ("ids", "known", "sizes", "text", "runs")))


def answers_of(table: pa.Table, rounds: int) -> list[dict[int, bytes]]:
    out: list[dict[int, bytes]] = [{} for _ in range(rounds)]
    for k, p, s in zip(table.column("round").to_pylist(), table.column("part").to_pylist(), table.column("states"), strict=True):
        out[k][p] = s.as_buffer()
    return out


def entries(block: Block, number: int, answers: list[dict[int, bytes]], parts: int) -> pa.RecordBatch:
    own, blobs = Doubling(block, answers, parts).round.packed(parts)
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.full(len(own), number), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block", "data"])


def first_entries(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), blocks_of(batch), strict=True):
                yield entries(block, number, [], parts)

    return run


def further_entries(parts: int, rounds: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([entries(block, key[0].as_py(), answers_of(right, rounds), parts) for block in blocks_of(left)])  # one row a block

    return run


def dedup_rounds(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Text blocks, the answers (round, block, part, states) of all rounds, and the number of parts."""
    blocks = text_blocks(docs)
    parts = C.parts_for(docs, 4)
    answers = None
    for k in range(ROUNDS):

        schema = "part long, block long, data binary"
        sent = blocks.mapInArrow(first_entries(parts), schema) if answers is None else blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(further_entries(parts, k), schema)
        settled = sent.groupBy("part").applyInArrow(settle, "block long, part long, states binary")
        settled = C.materialize(settled.select(F.lit(k).alias("round"), "block", "part", "states"), f"answers_{k}", "lz4")
        answers = settled if answers is None else answers.unionByName(settled)
    return blocks, answers, parts


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals as maximal runs; intervals never cross documents."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    reach = np.maximum.accumulate(end)  # starts rise with the row, so earlier documents end before
    new = np.append(True, (start[1:] > reach[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(row)) - 1]


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes, of every row."""
    blocks, answers, parts = dedup_rounds(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def apply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in blocks_of(left):
            n = len(block.ids)
            found = Doubling(block, answers_of(right, ROUNDS), parts).removed
            row, start, end = merged(*(np.concatenate([x[k] for x in found]) for k in range(3)))
            removed = np.bincount(row, end - start, minlength=n).astype(np.int64)
            count = np.bincount(row, minlength=n)
            edge = np.zeros(len(block.buf) + 1, np.int8)
            np.add.at(edge, start, 1)
            np.add.at(edge, end, -1)
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            kept = [block.buf[a:b][keep[a:b]].tobytes() if c else block.buf[a:b].tobytes() for a, b, c in zip(block.off[:-1], block.off[1:], count, strict=True)]
            cols = {"doc_id": pa.array(block.ids, mask=~block.known), "n_bytes": np.diff(block.off), "n_removed": removed, "n_spans": count, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
            if with_text:
                cols["kept"] = pa.array(kept, pa.binary())
            out.append(pa.table(cols))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), (pa.int64(),) * 4 + (pa.string(), pa.binary()), strict=True) if with_text or n != "kept"})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, schema)
