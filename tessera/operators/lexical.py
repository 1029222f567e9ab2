"""The inverted index as blocks of postings, and exact BM25 over a batch of queries.

Chunks are dealt to parts by a hash of their document.  A block is a row: the postings of one term in one part, packed into
arrays, with what bounds every score in it (the greatest frequency, the least length).  Nothing in a block depends on other
chunks, so blocks of changed documents can be added and withdrawn; document frequencies are sums over blocks.

A term's contribution to a score is rounded to a whole number of units once, and units are added: the sum is the same in any
order, on any number of tasks, and ties are ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Units of a score.
UNIT = 10**8
#: Chunks of a part on average; in indexes of at most SINGLE parts no part's bounds are looked at.
PART_CHUNKS, SINGLE = 4096, 64
#: Queries that meet a part together, and that a task keeps results of before it sends them on.
QUERY_BLOCK, KEPT = 4096, 50_000
#: Queries that are scored together, cells of their scores, and postings that are added together.
SLICE, CELLS, HITS = 64, 1 << 18, 1 << 18
#: A term is part of the matrix product where its postings, over all queries, are more than one in so many cells of scores.
SHARED = 128
#: So many distinct terms of queries, at most, are sent to all tasks to pick their blocks; of more, all blocks are dealt.
SENT_TERMS = 100_000

BLOCKS = "part int, term string, gen long, n long, chunk_ids array<long>, tfs array<int>, lengths array<int>, most int, least int"
#: Sums over chunks: how many, and their tokens.
TOTALS = "part int, gen long, n_chunks long, n_tokens long"


# ---------------------------------------------------------------- the index
def parts_of(n_chunks: int, of_chunks: int = PART_CHUNKS) -> int:
    return max(1, math.ceil(n_chunks / of_chunks))


def part_of(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(parts)).cast("int")


def _tokens(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("terms", X.index_terms(F.concat_ws("\n", "content", "heading")))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) over heading and content; counted within a chunk, so no shuffle on terms."""
    terms = _tokens(chunks)
    return terms.select("chunk_id", F.explode("terms").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf")


def blocks(chunks: DataFrame, parts: int, gen: int = 0) -> DataFrame:
    """Blocks of chunks (chunk_id, doc_id, heading, content).  Texts are dealt by part once; all counting is within parts."""
    own = chunks.select("chunk_id", part_of(F.col("doc_id"), parts).alias("part"), "content", "heading").repartition(parts, "part")
    terms = _tokens(own).select("part", "chunk_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    counted = terms.groupBy("part", "chunk_id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
    packed = counted.groupBy("part", "term").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "length"))).alias("p"))  # a part's chunks at most
    return packed.select(
        "part",
        "term",
        F.lit(gen).cast("long").alias("gen"),
        F.size("p").cast("long").alias("n"),
        F.col("p.chunk_id").alias("chunk_ids"),
        F.col("p.tf").alias("tfs"),
        F.col("p.length").alias("lengths"),
        F.array_max("p.tf").alias("most"),
        F.array_min("p.length").alias("least"),
    )


def totals(chunks: DataFrame, parts: int, gen: int = 0) -> DataFrame:
    length = F.size(X.index_terms(F.concat_ws("\n", "content", "heading")))
    own = chunks.select(part_of(F.col("doc_id"), parts).alias("part"), length.cast("long").alias("n_tokens"))
    return own.groupBy("part").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")).select("part", F.lit(gen).cast("long").alias("gen"), "n_chunks", "n_tokens")


def totals_of(blocks: DataFrame, n_chunks: int, gen: int = 0) -> DataFrame:
    """The totals of so many chunks from their blocks, without their texts: frequencies add up to tokens."""
    tokens = F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    return blocks.agg(tokens.cast("long").alias("n_tokens")).select(F.lit(0).alias("part"), F.lit(gen).cast("long").alias("gen"), F.lit(n_chunks).cast("long").alias("n_chunks"), "n_tokens")


def withdrawn(chunks: DataFrame, parts: int, gen: int) -> tuple[DataFrame, DataFrame]:
    """Blocks and totals that take chunks out of the sums again; the chunks' postings are told apart by their generation."""
    terms = postings(chunks).join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy(part_of(F.col("doc_id"), parts).alias("part"), "term").agg(F.count("*").alias("n"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    minus = terms.select("part", "term", F.lit(gen).cast("long").alias("gen"), (-F.col("n")).alias("n"), none("long").alias("chunk_ids"), none("int").alias("tfs"), none("int").alias("lengths"), F.lit(0).alias("most"), F.lit(1).alias("least"))
    sums = totals(chunks, parts, gen)
    return minus, sums.select("part", "gen", (-F.col("n_chunks")).alias("n_chunks"), (-F.col("n_tokens")).alias("n_tokens"))


@dataclass
class Inverted:
    """Blocks, totals, the number of parts, and what was withdrawn: (part, chunk_id, gen), postings older than gen."""

    blocks: DataFrame
    totals: DataFrame
    parts: int
    gone: DataFrame | None = None

    @classmethod
    def of(cls, chunks: DataFrame, parts: int = 1) -> Inverted:
        return cls(blocks(chunks, parts), totals(chunks, parts), parts)

    def narrowed(self, terms: list[str]) -> Inverted:
        """Only these terms' blocks, by a filter that reaches the files; the totals stay the corpus's."""
        return Inverted(self.blocks.where(F.col("term").isin(terms)), self.totals, self.parts, self.gone)

    def postings(self) -> DataFrame:
        """(term, chunk_id, tf) of what is not withdrawn."""
        zipped = F.explode(F.arrays_zip("chunk_ids", "tfs")).alias("p")
        out = self.blocks.where("n > 0").select("term", "gen", zipped).select("term", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.tfs").cast("long").alias("tf"), "gen")
        if self.gone is not None:
            late = self.gone.groupBy(F.col("chunk_id").alias("_chunk")).agg(F.max("gen").alias("_gen"))
            out = out.join(late, (F.col("chunk_id") == F.col("_chunk")) & (F.col("gen") < F.col("_gen")), "left_anti")
        return out.select("term", "chunk_id", "tf")


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df) of postings, or of blocks."""
    return index.groupBy("term").agg((F.sum("n") if "n" in index.columns else F.count("*")).alias("df"))


# ---------------------------------------------------------------- queries
def wanted_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): a repeated term counts as often as it is written."""
    terms = F.transform(X.query_terms(F.col("text")), lambda t: X.folded(t))
    return queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def rareness(n: Column, df: Column) -> Column:
    rare = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(rare > 0, rare).otherwise(IDF_FLOOR)


def weight(rare, tf, length, average):
    """One term's contribution; the same operations in columns and in numpy."""
    return rare * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def top(scores: DataFrame, limit: int, best: Column, *ties: Column) -> DataFrame:
    """The first ``limit`` rows of each query with their rank; the literal bound lets Spark cut before the shuffle."""
    order = W.partitionBy("query_id").orderBy(best, *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


_PART = ("terms", "p_cut", "chunks", "place", "tfs", "lengths", "most", "least")
_ASKED = "ids binary, known array<string>, rares binary, average double, cut binary, at binary, times binary"
_SCORED = "query_id long, chunk_id long, units long"


def _pressed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and marks of a part that stand together become one compressed row, for the one time that they are moved."""
    for batch in batches:
        of, ids = batch["part"].to_numpy(), batch["chunk_ids"]
        ids = pa.ListArray.from_arrays(ids.offsets, ids.values.dictionary_encode(), mask=ids.is_null())
        rest = [c for c in batch.schema.names if c not in ("part", "chunk_ids")]
        batch = pa.RecordBatch.from_arrays([ids, *(batch[c] for c in rest)], names=["chunk_ids", *rest])
        ends = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if hi > lo:
                yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int32()), pa.array([_pressed(batch.slice(lo, hi - lo))], pa.binary())], names=["part", "rows"])


def _parts(filtered: bool):
    """Sealed rows in the order of parts become one compressed row a part: its postings that compete, by term."""

    def part(number: int, rows: list[bytes]) -> pa.RecordBatch | None:
        tables = [pa.ipc.open_stream(r).read_all() for r in rows]
        plain = lambda t: t.set_column(0, "chunk_ids", pc.cast(t["chunk_ids"], pa.list_(pa.int64())))
        own = pa.concat_tables([plain(t) for t in tables])
        kinds = own["kind"].to_numpy()
        posted = own.filter(pa.array(kinds == 0))
        terms = pc.unique(posted["term"])
        ids, tf, length = (pc.list_flatten(posted[c]).to_numpy() for c in ("chunk_ids", "tfs", "lengths"))
        count = pc.list_value_length(posted["chunk_ids"]).to_numpy()
        term, gen = np.repeat(pc.index_in(posted["term"], value_set=terms).to_numpy(), count), np.repeat(posted["gen"].to_numpy(), count)
        keep = _standing(own.filter(pa.array(kinds == 2)), ids, gen)
        if filtered:
            keep &= np.isin(ids, pc.list_flatten(own.filter(pa.array(kinds == 1))["chunk_ids"]).to_numpy())
        order = np.flatnonzero(keep)[np.argsort(term[keep], kind="stable")]
        if not len(order):
            return None
        ids, tf, length, term = ids[order], tf[order], length[order], term[order]
        here, term = np.unique(term, return_inverse=True)
        cut = np.searchsorted(term, np.arange(len(here) + 1))
        chunks, place = np.unique(ids, return_inverse=True)
        packed = (cut, chunks, place.astype(np.int32), tf, length, np.maximum.reduceat(tf, cut[:-1]), np.minimum.reduceat(length, cut[:-1]))
        columns = [pa.array([terms.take(pa.array(here)).to_pylist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
        row = _pressed(pa.RecordBatch.from_arrays(columns, names=list(_PART)))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([row], pa.binary())], names=["part", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(batch["part"].to_pylist(), batch["rows"].to_pylist(), strict=True))
        for number, own in groupby(rows, key=lambda r: r[0]):
            if (row := part(number, [r for _, r in own])) is not None:
                yield row

    return run


def _questions(most: int):
    """Rows of queries become rows of up to ``most`` queries, with a list of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                own = batch.slice(lo, most)
                flat = pc.list_flatten(own["terms"])
                known = pc.unique(flat)
                at = pc.index_in(flat, value_set=known).to_numpy()
                rares = np.zeros(len(known))
                rares[at] = pc.list_flatten(own["rares"]).to_numpy()
                cut = np.append(0, np.cumsum(pc.list_value_length(own["terms"]).to_numpy(), dtype=np.int64))
                raw = lambda x: pa.array([x.tobytes()], pa.binary())
                columns = [raw(own["query_id"].to_numpy()), pa.array([known.to_pylist()], pa.list_(pa.string())), raw(rares), own["average"].slice(0, 1), raw(cut), raw(at.astype(np.int32)), raw(pc.list_flatten(own["times"]).to_numpy().astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ASKED.split(", ")])

    return run


class _Sums:
    """Sums of the units of a part's chunks for queries that ask for its terms (query, term, times), a slice of queries at a
    time.  Terms that many queries and chunks share are a matrix product, the others are added posting by posting; all are
    whole numbers below 2^53, so that sums are exact in any order."""

    def __init__(self, cut: np.ndarray, place: np.ndarray, chunks: int, of: np.ndarray, at: np.ndarray, times: np.ndarray, queries: int):
        self.cut, self.place, self.chunks, self.queries = cut, place, chunks, queries
        self.step = max(1, min(SLICE, CELLS // max(1, chunks)))
        size = np.diff(cut)
        hits = np.bincount(at, minlength=len(size)) * size
        shared = np.flatnonzero(hits * SHARED > queries * chunks)
        self.shared = shared[np.argsort(-hits[shared], kind="stable")][: 16 * CELLS // max(1, chunks)]
        row = np.full(len(size), -1)
        row[self.shared] = np.arange(len(self.shared))
        dense = row[at] >= 0
        self.dense, self.rest = (of[dense], row[at[dense]], times[dense]), (of[~dense], at[~dense], times[~dense])
        self.dense_cut, self.rest_cut = (np.searchsorted(x[0], np.arange(queries + 1)) for x in (self.dense, self.rest))

    def _postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of terms are, one term after another, and how many each has."""
        size = self.cut[terms + 1] - self.cut[terms]
        return np.repeat(self.cut[terms] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum()), size

    def _table(self, units: np.ndarray) -> np.ndarray:
        hit, size = self._postings(self.shared)
        flat = np.repeat(np.arange(len(size)) * self.chunks, size) + self.place[hit]
        return np.bincount(flat, units[hit], len(size) * self.chunks).reshape(len(size), self.chunks)

    def slice(self, units: np.ndarray, lo: int, table: np.ndarray | None = None) -> np.ndarray:
        """A row a query from ``lo`` on, a column a chunk."""
        n = min(self.step, self.queries - lo)
        asked = np.zeros((n, len(self.shared)))
        a, b = self.dense_cut[lo], self.dense_cut[lo + n]
        of, row, times = (x[a:b] for x in self.dense)
        np.add.at(asked, (of - lo, row), times)
        score = asked @ (self._table(units) if table is None else table)
        a, b = self.rest_cut[lo], self.rest_cut[lo + n]
        of, at, times = (x[a:b] for x in self.rest)
        upto = np.cumsum(self.cut[at + 1] - self.cut[at])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, "right")))
            hit, size = self._postings(at[begin:end])
            first, count = of[begin], of[end - 1] + 1 - of[begin]
            flat = np.repeat((of[begin:end] - first) * self.chunks, size) + self.place[hit]
            score[first - lo : first - lo + count] += np.bincount(flat, units[hit] * np.repeat(times[begin:end], size), count * self.chunks).reshape(count, self.chunks)
            begin = end
        return score

    def of(self, units: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        table = self._table(units)
        for lo in range(0, self.queries, self.step):
            yield lo, self.slice(units, lo, table)


def _scores(limit: int, bounded: bool):
    """Pairs of a part and a block of queries: of all the parts that a task meets, the first ``limit`` chunks of each query,
    ties to the smaller chunk id.  bounded: a part whose best possible score is below a query's last one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # query -> chunks and scores

        def rows() -> pa.RecordBatch:
            size = [len(c) for c, _ in best.values()]
            join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
            columns = [np.repeat(np.array(list(best), np.int64), size), join([c for c, _ in best.values()], np.int64), join([u for _, u in best.values()], np.int64)]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "chunk_id", "units"])

        def meet(row: dict) -> None:
            num = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
            cut, chunks, place, tf, length = (num(n, k) for n, k in (("p_cut", np.int64), ("chunks", np.int64), ("place", np.int32), ("tfs", np.int32), ("lengths", np.int32)))
            ids, ends, at, times, rare = num("ids", np.int64), num("cut", np.int64), num("at", np.int32), num("times", np.int32), num("rares", np.float64)
            average = row["average"].as_py()
            found = pc.index_in(row["known"].values, value_set=row["terms"].values)
            known, where = found.is_valid().to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy(zero_copy_only=False)
            rares = np.zeros(len(cut) - 1)
            rares[where[known]] = rare[known]
            units = np.rint(weight(np.repeat(rares, np.diff(cut)), tf, length, average) * UNIT)
            positive = bool(len(units)) and units[np.repeat(rares, np.diff(cut)) > 0].min(initial=1) > 0
            of, here = np.repeat(np.arange(len(ids)), np.diff(ends)), known[at]
            of, at, times = of[here], where[at[here]], times[here]
            held = [best.get(q) for q in ids.tolist()]
            last = np.array([h[1][-1] if h is not None and len(h[1]) == limit else -1 for h in held], np.float64)
            alive = np.bincount(of, minlength=len(ids)) > 0
            if bounded:
                bounds = np.ceil(weight(rares, num("most", np.int32), num("least", np.int32), average) * UNIT) + 1
                alive &= np.bincount(of, bounds[at] * times, len(ids)) >= last
            of, at, times = (x[alive[of]] for x in (of, at, times))
            which = np.flatnonzero(alive)
            of = np.searchsorted(which, of)
            sums = _Sums(cut, place, len(chunks), of, at, times, len(which))
            for lo, score in sums.of(units):
                mine = which[lo : lo + len(score)]
                hits = score >= np.maximum(last[mine], 1 if positive else -1)[:, None]
                if not positive:
                    hits &= sums.slice(np.ones(len(units)), lo) > 0
                for r in np.flatnonzero(hits.any(1)).tolist():
                    own, got, h = np.flatnonzero(hits[r]), score[r], held[mine[r]]
                    if len(own) > limit:
                        least = np.partition(got[own], len(own) - limit)[len(own) - limit]
                        own = own[got[own] >= least]
                    near, got = chunks[own], got[own]
                    if h is not None:
                        near, got = np.append(h[0], near), np.append(h[1], got)
                    order = np.lexsort((near, -got))[:limit]
                    best[int(ids[mine[r]])] = near[order], got[order]

        for batch in batches:
            for i in range(batch.num_rows):
                own = pa.ipc.open_stream(batch["postings"][i].as_buffer()).read_next_batch()
                meet({n: batch[n][i] for n in batch.schema.names} | {n: own[n][0] for n in _PART})
            if len(best) > KEPT:
                yield rows()
        yield rows()

    return run


def _standing(gone: pa.Table, ids: np.ndarray, gen: np.ndarray) -> np.ndarray:
    """Which postings are not withdrawn by a later generation."""
    if not len(gone):
        return np.ones(len(ids), bool)
    late, since = pc.list_flatten(gone["chunk_ids"]).to_numpy(), np.repeat(gone["gen"].to_numpy(), pc.list_value_length(gone["chunk_ids"]).to_numpy())
    order = np.lexsort((since, late))
    late, since = late[order], since[order]
    last = np.searchsorted(late, ids, "right") - 1  # the latest of each chunk
    hit = (last >= 0) & (late[np.maximum(last, 0)] == ids)
    return ~(hit & (gen < since[np.maximum(last, 0)]))


def spread(stored: int, queries: int, block: int, cores: int) -> tuple[int, int]:
    """Into how many partitions go what is searched (so many rows) and the queries, blocks of so many: two tasks a core where
    that can be, and of these as many by queries as there are blocks, since each group of what is searched sends on its own
    first rows of every query."""
    asking = max(1, min(2 * cores, math.ceil(queries / block)), min(queries, math.ceil(2 * cores / max(1, min(stored, cores)))))
    return max(1, min(stored, cores, math.ceil(2 * cores / asking))), asking


def search_lexical(queries: DataFrame, index: Inverted, limit: int, allowed: DataFrame | None = None, single: int = SINGLE) -> DataFrame:
    """(query_id, chunk_id, score, rank); only chunks in ``allowed`` (chunk_id, doc_id) compete, statistics stay the corpus's.

    Parts and blocks of queries are rows of their own, written once, and each part meets each block.  A task sends on the
    first rows of all its parts together; with many queries there are few groups of parts, so that few rows a query are
    shuffled.  The tasks that meet run no other Python.
    In an index of more than ``single`` parts, one that cannot hold a chunk of a query's first rows is not scored for it.
    """
    wanted = wanted_terms(queries)
    size = wanted.agg(F.count_distinct("term").alias("terms"), F.count_distinct("query_id").alias("queries")).first()
    terms, cores = wanted.select("term").distinct(), queries.sparkSession.sparkContext.defaultParallelism
    own = index.blocks.join(F.broadcast(terms), "term", "left_semi") if size["terms"] <= SENT_TERMS else index.blocks
    slim = index.blocks.select("part", "term", "n").join(terms, "term", "left_semi")  # without the postings
    stats = index.totals.agg(F.sum("n_chunks").alias("n_chunks"), (F.sum("n_tokens") / F.sum("n_chunks")).alias("average"))
    asked = wanted.join(document_frequency(slim).where("df > 0"), "term").crossJoin(stats)  # one row
    asked = asked.select("query_id", "term", F.col("times").cast("int").alias("times"), "average", rareness(F.col("n_chunks"), F.col("df")).alias("rare"))
    listed = F.collect_list(F.struct("term", "times", "rare"))  # one query's terms
    packed = asked.groupBy("query_id").agg(listed.alias("t"), F.first("average").alias("average"))
    packed = packed.select(F.col("query_id").cast("long").alias("query_id"), F.col("t.term").alias("terms"), F.col("t.times").alias("times"), F.col("t.rare").alias("rares"), "average")
    left = own.where("n > 0").select("part", "term", "gen", "chunk_ids", "tfs", "lengths", F.lit(0).alias("kind"))
    marks = []
    if allowed is not None:
        marks.append(_marked(allowed.select(part_of(F.col("doc_id"), index.parts).alias("part"), "chunk_id", F.lit(0).cast("long").alias("gen")), 1))
    if index.gone is not None:
        marks.append(_marked(index.gone, 2))
    for m in marks:
        left = left.unionByName(m, allowMissingColumns=True)
    dealt = min(index.parts, cores)
    held, asking = spread(index.parts, size["queries"], QUERY_BLOCK, cores)
    left = left.mapInArrow(_sealed, "part int, rows binary").repartitionById(dealt, F.pmod(F.col("part"), F.lit(dealt))).sortWithinPartitions("part").mapInArrow(_parts(allowed is not None), "part int, postings binary")
    left = left.repartitionById(held, F.pmod(F.col("part"), F.lit(held)))  # so that no part is made a second time
    right = packed.repartition(asking).mapInArrow(_questions(QUERY_BLOCK), _ASKED).repartitionById(asking, F.spark_partition_id())
    pairs = left.crossJoin(right)  # the stated queries, in blocks
    scores = pairs.mapInArrow(_scores(limit, index.parts > single), _SCORED)
    return top(scores, limit, F.col("units").desc(), F.col("chunk_id")).select("query_id", "chunk_id", (F.col("units") / UNIT).alias("score"), "rank")


def _marked(chunks: DataFrame, kind: int) -> DataFrame:
    """Chunks of a part in one row a generation, beside its blocks."""
    ids = F.collect_list("chunk_id").alias("chunk_ids")  # a part's chunks at most
    return chunks.groupBy("part", "gen").agg(ids).withColumn("kind", F.lit(kind))
