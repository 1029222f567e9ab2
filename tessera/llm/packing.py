"""Best-fit packing by the linear grouping scheme.

Documents become token pieces of at most ``capacity`` ids.  How pieces share sequences is decided from the
histogram of piece lengths alone - at most ``capacity`` numbers, however large the corpus - and carried out by
ranking the pieces of each length.  Large lengths are rounded up within groups of equal cardinality, a cutting-stock
program over these few sizes is solved by column generation, actual pieces take the slots of their group, and the
small pieces then go best-fit into what is left.

Null and empty texts are documents of one end token.  Equal rows are packed as often as they occur.  Rows whose
``doc_id`` is null keep it null.  An empty table gives an empty result.  Only ``doc_id`` and ``text`` are read, so
other columns may have any name.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common as C

CAPACITY = 1024
END_ID = 2
#: Pieces from capacity / LARGE up count as large.  They are rounded up in groups of MEMBERS pieces (a
#: five-hundredth of them where they are few), or in GROUPS groups of more.
LARGE, MEMBERS, GROUPS = 8, 12, 512
#: How far from the best the program may end, and the most pivots it may take.
SLACK, PIVOTS = 4e-4, 2500
#: Parts in which the pieces of one length are ranked on their own: a common length never meets in one task.
RANK_PARTS = 512


class Tokens:
    """Token ids of a byte-level BPE vocabulary; a text holding a special token's string goes through the slower library that knows it."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text), np.uint32) if text else np.zeros(0, np.uint32)


def default_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else full pieces behind a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, vocabulary=None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    files = vocabulary or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*files)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cols: list[list] = [[], [], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(tokens.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        row = (doc_id, k, start, length, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                k = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds[:k], strict=True)], names=names[:k])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan, from the histogram
def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that sizes (falling) are worth together in each room up to capacity, and the size put last (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes[-1])
    from_ = np.searchsorted(-sizes, -np.arange(capacity + 1), "left")  # the first size that fits
    for c in range(least, capacity + 1):
        with_one = best[c - sizes[from_[c] :]] + worth[from_[c] :]
        i = int(with_one.argmax())
        if with_one[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = with_one[i], from_[c] + i
        else:
            best[c] = best[c - 1]
    return best, pick


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A triangular basis: each size with as many smaller ones as their demand allows, the largest first."""
    n, rest = len(sizes), demand.astype(float)
    basis = np.zeros((n, n))
    for j in range(n):
        basis[j, j] = capacity // sizes[j]
        times, gap = max(rest[j], 0) / basis[j, j], capacity - basis[j, j] * sizes[j]
        while times > 0:
            fits = np.flatnonzero((sizes[j + 1 :] <= gap) & (rest[j + 1 :] >= times))
            if not len(fits):
                break
            i = j + 1 + int(fits[0])
            k = min(gap // sizes[i], rest[i] // times)
            basis[i, j] += k
            rest[i] -= k * times
            gap -= k * sizes[i]
    return basis


def inverted(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, element by element: threaded matrix libraries stall in a driver beside a busy JVM."""
    n = len(basis)
    a = np.concatenate([basis, np.eye(n)], 1)
    for k in range(n):
        r = k + int(np.abs(a[k:, k]).argmax())
        if r != k:
            a[[k, r]] = a[[r, k]]
        a[k] /= a[k, k]
        rows = np.flatnonzero(a[:, k])
        rows = rows[rows != k]
        a[rows] -= a[rows, k][:, None] * a[k]
    return a[:, n:]


def times_vector(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(1)


def configurations(sizes: list[int], demand: list[int], capacity: int, slack: float = SLACK, pivots: int = PIVOTS) -> list[tuple[list[int], int]]:
    """(pattern, how often) of the cutting-stock program over sizes in falling order.

    Revised simplex with generated columns, until no solution can be better by more than ``slack`` or after ``pivots``
    steps; any basis on the way holds the demand.  Fractions are rounded down, then up where a whole pattern is left.
    """
    n = len(sizes)
    if not n:
        return []
    size, need = np.array(sizes), np.array(demand, float)
    basis = first_basis(size, need, capacity)
    inverse = inverted(basis)
    x, done, moved = times_vector(inverse, need), 0, True
    while moved and done < pivots:
        worth, moved = inverse.sum(0), False
        best, pick = knapsack(size, worth, capacity)
        led = worth + best[capacity - size]  # the best pattern that holds each size
        if led.max() <= 1 + slack:
            break
        for i in np.argsort(-led)[:24]:
            if led[i] <= 1 + slack / 2:
                break
            column, room = np.zeros(n), capacity - size[i]
            column[i] = 1
            while room >= size[-1]:
                if pick[room] < 0 or best[room] == best[room - 1]:
                    room -= 1
                else:
                    column[pick[room]] += 1
                    room -= size[pick[room]]
            if (inverse.sum(0) * column).sum() <= 1 + slack / 2:  # earlier columns of this turn may have changed the worths
                continue
            step = times_vector(inverse, column)
            rising = step > 1e-7
            if not rising.any():
                continue
            r = int(np.argmin(np.where(rising, x / np.where(rising, step, 1), np.inf)))
            basis[:, r] = column
            inverse[r] /= step[r]
            step[r] = 0
            x[r] = max((inverse[r] * need).sum(), 0)
            inverse -= np.outer(step, inverse[r])
            done, moved = done + 1, True
            if done % 1000 == 0:
                inverse = inverted(basis)
            x = np.maximum(times_vector(inverse, need), 0)
    x = times_vector(inverted(basis), need)
    if not (np.isfinite(x).all() and x.min() > -1e-6 and np.allclose(times_vector(basis, x), need)):  # a basis that rounding has spoilt
        basis = first_basis(size, need, capacity)
        x = times_vector(inverted(basis), need)
    x = np.maximum(x, 0)
    times = np.floor(x + 1e-7).astype(np.int64)
    left = need - times_vector(basis, times)
    for j in np.argsort(times - x):
        if basis[:, j].any() and x[j] > 1e-7 and (left >= basis[:, j] - 1e-7).all():
            times[j] += 1
            left -= basis[:, j]
    return [(basis[:, j].astype(int).tolist(), int(times[j])) for j in np.flatnonzero(times)]


def grouped(left: dict[int, int], capacity: int) -> dict[int, list[list[int]]]:
    """Large lengths in groups of equal cardinality: the length each group is rounded up to -> its runs [length, pieces].

    Groups that are rounded up to one length are one size to the program.
    """
    large = sorted((s for s in left if s * LARGE >= capacity), reverse=True)
    total = sum(left[s] for s in large)
    each = max(1, min(MEMBERS, total // 500), -(-total // GROUPS))
    out: dict[int, list[list[int]]] = {}
    room, top = 0, 0
    for s in large:
        n = left[s]
        if n >= each:  # a frequent length is groups of its own, all rounded to itself
            top, room = s, n
        while n:
            if room == 0:
                top, room = s, each
            take = min(n, room)
            runs = out.setdefault(top, [])
            if runs and runs[-1][0] == s:
                runs[-1][1] += take
            else:
                runs.append([s, take])
            n, room = n - take, room - take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences: (how many, [(length, pieces of it), ...]) that hold every piece of the histogram once."""
    return plan_and_report(histogram, capacity)[0]


def plan_and_report(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[str, int]]:
    """The plan, and how many pieces came by which step: full, configured, or fitted (large ones and small ones)."""
    left = {s: n for s, n in histogram.items() if n > 0}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    report = {"full": left.get(capacity, 0), "configured": 0, "fitted_large": 0, "fitted_small": 0}
    if capacity in left:
        done.append((left.pop(capacity), [(capacity, 1)]))
    runs = grouped(left, capacity)
    tops = sorted(runs, reverse=True)
    open_bins: dict[tuple[int, tuple[tuple[int, int], ...]], int] = {}  # (gap, content) -> how many
    for pattern, times in configurations(tops, [sum(n for _, n in runs[t]) for t in tops], capacity):
        slots = [(t, c) for t, c in zip(tops, pattern, strict=True) if c]
        while times:
            # actual pieces take the slots; a stretch of like sequences ends where a group's run of one length does
            m = min(times, *(runs[t][0][1] // c if runs[t] else 0 for t, c in slots)) or 1
            content: dict[int, int] = {}
            for t, c in slots:
                for _ in range(c):  # one slot after another where a run ends inside a sequence
                    if runs[t]:
                        content[runs[t][0][0]] = content.get(runs[t][0][0], 0) + 1
                        runs[t][0][1] -= m
                        if not runs[t][0][1]:
                            runs[t].pop(0)
            times -= m
            if content:
                report["configured"] += m * sum(content.values())
                key = (capacity - sum(s * c for s, c in content.items()), tuple(sorted(content.items(), reverse=True)))
                open_bins[key] = open_bins.get(key, 0) + m
    rest = {s: n for s, n in left.items() if s * LARGE < capacity}
    report["fitted_small"] = sum(rest.values())
    for t in tops:  # what rounding the program down leaves
        for s, n in runs[t]:
            rest[s] = rest.get(s, 0) + n
            report["fitted_large"] += n
    return done + best_fit(open_bins, rest, capacity), report


def best_fit(open_bins: dict, rest: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The open sequences with the rest put in best-fit, in falling length; new ones where nothing has room."""
    by_gap: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    for (gap, content), n in open_bins.items():
        by_gap.setdefault(gap, {})[content] = by_gap.get(gap, {}).get(content, 0) + n
    gaps = sorted(by_gap)

    def put(gap: int, content: tuple[tuple[int, int], ...], n: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = {}
            bisect.insort(gaps, gap)
        by_gap[gap][content] = by_gap[gap].get(content, 0) + n

    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):  # no open sequence has room: new ones, each filled with this length
                per = capacity // s
                if n >= per:
                    put(capacity - per * s, ((s, per),), n // per)
                    n %= per
                else:
                    put(capacity - n * s, ((s, n),), 1)
                    n = 0
                continue
            gap = gaps[at]
            content, have = by_gap[gap].popitem()
            per = gap // s if n >= gap // s * have else 1  # whole classes at once where there are pieces enough
            take = min(have, n // per)
            if have > take:
                by_gap[gap][content] = have - take
            elif not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            inside = dict(content)
            inside[s] = inside.get(s, 0) + per
            put(gap - per * s, tuple(sorted(inside.items(), reverse=True)), take)
            n -= take * per
    return [(n, list(content)) for gap in gaps for content, n in by_gap[gap].items()]


def segments(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, stretches of ranks and where they go: the r-th piece of a length finds its sequence and place here."""
    rows, used, first = [], {}, 0
    for times, content in kinds:
        offset = 0
        for s, c in content:
            k = used.get(s, 0)
            rows.append((s, k, c, first, offset))
            used[s] = k + times * c
            offset += s * c
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "per", "sequence", "offset"), table.T, strict=True))


# ---------------------------------------------------------------- carrying it out
def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (read twice: give a written table)."""
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS)).cast("int")
    dealt = pieces.withColumn("_part", part)
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = C.materialize(counts, "length_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    where = segments(plan(histogram, capacity))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(own)).join(offsets, ["length", "_part"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    schema = spark.createDataFrame([], pieces.schema).schema.add("sequence_id", "long").add("offset", "long")
    scale = np.int64(1 << 40)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = where["length"] * scale + where["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * scale + rank, "right") - 1
            inner = rank - where["rank"][at]
            sequence = where["sequence"][at] + inner // where["per"][at]
            offset = where["offset"][at] + inner % where["per"][at] * length
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary=None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return assign(C.materialize(token_pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces"), capacity)
