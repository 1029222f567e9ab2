"""Near-duplicate documents by ProbMinHash over five-word shingles.

Shingles are weighted by how often they occur in their text.  Each is a Poisson process whose rate is its weight and
whose arrivals pick one of ``REGISTERS`` registers; a register keeps the shingle that arrives first, and a shingle
stops as soon as its next arrival comes after the last first-arrival of its text.  Two texts agree in a register with
the probability Jaccard similarity of their weights (plain Jaccard where no shingle repeats).  Bands of ``ROWS``
registers make candidates, and every candidate pair is verified by its exact probability Jaccard similarity.

Texts of equal word sequences are one class; only one document of a class is banded.  A bucket of a band does not emit
its pairs: all its classes are compared with one centre, those that are not linked with it with a second, and so on;
then buckets that still hold several components are compared pair by pair where they are small, and joined by an exact
prefix filter where they are not, so no link between components is lost however large a bucket is.  Components of the verified links are the groups.

Classes are told apart by 128 bits of the word sequence.  A text of one to four words is one shingle.  Very long texts are
hashed whole.  Null, empty and blank texts are nobody's duplicates.  Rows with equal ids
or equal rows are documents of their own; of a group the row with the smallest doc_id (null last) stays.  An empty table
gives an empty result.  Input columns travel inside one struct, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common as C
from tessera.llm.components import components

WORDS, SIMILARITY = 5, 0.8
REGISTERS, ROWS = 64, 4
#: Rounds in which a bucket's unlinked classes get another centre before the remaining pairs are compared.
ROUNDS = 3
#: A bucket that still holds several components is compared pair by pair up to this size; larger ones go through the
#: prefix filter, which is as exact and does not grow with the square.
FEW = 24
#: What the filters let pass below the similarity, against rounding; verification decides.
SLACK = 1e-9
#: Slots in which shingles are counted to put rare ones first.
SLOTS = 1 << 18

_U = np.uint64


def shingles(buf: np.ndarray, off: np.ndarray, n: int = WORDS):
    """Per block: document row, hash and count of every distinct shingle (by row, then hash); class hashes; words."""
    start, end, doc = C.word_spans(buf, off)
    h = C.word_hashes(buf, start, end)
    docs = len(off) - 1
    words = np.bincount(doc, minlength=docs)
    g, at = C.gram_hashes(h, doc, n)
    first = np.cumsum(words) - words
    place = (np.arange(len(h)) - first[doc]).astype(_U) if len(h) else np.zeros(0, _U)
    # the word sequence as a whole, twice: equal texts meet, whatever their white space
    whole = []
    for salt in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7):
        total = np.zeros(docs, _U)
        np.add.at(total, doc, C.mix(h + (place + _U(1)) * _U(salt)))
        whole.append(C.mix(total + words.astype(_U)))
    short = np.flatnonzero((words > 0) & (words < n))
    row = np.concatenate([doc[at], short])
    g = np.concatenate([g, whole[0][short]])
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(g)))
    return row[at], g[at], count, whole, words


def prob_min_hash(row: np.ndarray, g: np.ndarray, weight: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """(docs, m) registers holding the shingle that arrived first."""
    times = np.full(docs * m, np.inf)
    who = np.zeros(docs * m, _U)
    t = np.zeros(len(g))
    k = 0
    while len(g):
        k += 1
        r = C.mix(g + _U(0xA0761D6478BD642F * k % (1 << 64)))
        u = ((r >> _U(11)).astype(np.float64) + 1) / (1 << 53)
        t = t - np.log(u) / weight
        at = row * m + (C.mix(r) % _U(m)).astype(np.int64)
        np.minimum.at(times, at, t)
        won = times[at] == t
        who[at[won]] = g[won]
        last = times.reshape(docs, m).max(1)
        go = t < last[row]
        row, g, weight, t = row[go], g[go], weight[go], t[go]
    return who.reshape(docs, m)


def probability_jaccard(x: np.ndarray, xw: np.ndarray, y: np.ndarray, yw: np.ndarray) -> float:
    """Exact similarity of two weighted sets given by sorted hashes and weights."""
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if (xw == 1).all() and (yw == 1).all():
        return len(common) / (len(x) + len(y) - len(common))
    a, b = xw[i].astype(float), yw[j].astype(float)
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    only_x, only_y = xw.sum() - a.sum(), yw.sum() - b.sum()
    upto = np.searchsorted(ratio, ratio, "right")
    left = only_x + np.concatenate([[0], np.cumsum(a)])[upto]  # where y_j / x_j <= ratio: x_j / x_i is the larger
    right = only_y + b.sum() - np.concatenate([[0], np.cumsum(b)])[upto]
    return float(np.sum(1 / (left / a + right / b)))


def sketched(docs: DataFrame) -> DataFrame:
    """docs' columns as ``row``, block, rid, c and c2 (together the class), words and bands; written once, bucketed by block.

    A block is a stretch of a few MB of texts, so a task writes few files and texts are later read in place.
    """
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("t"))
    own = ("block", "rid", "c", "c2", "words")
    schema = T.StructType([src.schema["row"], *[T.StructField(n, T.LongType()) for n in own], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, n = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for i, j, buf, off in C.blocks(batch.column(1)):
                row, g, count, whole, words = shingles(buf, off)
                who = prob_min_hash(row, g, count.astype(float), j - i)
                bands = np.zeros((j - i, REGISTERS // ROWS), _U)
                for k in range(ROWS):
                    bands = (bands + who[:, k::ROWS]) * _U(0xB492B66FBE98F273 + 2 * k)
                bands = C.mix(bands + np.arange(bands.shape[1], dtype=_U))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1).view(np.int64)), bands.shape[1]).cast(pa.list_(pa.int64()))
                columns = (np.full(j - i, block), (block >> 24 << 40) + n + np.arange(j - i), whole[0].view(np.int64), whole[1].view(np.int64), words.astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.slice(i, j - i).column(0), *map(pa.array, columns), lists], names=schema.names)
                block, n = block + 1, n + j - i

    return C.bucketed(src.mapInArrow(run, schema), "sketches", "block", C.buckets_for(docs))


def shingle_sets(table: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """(c, set): sorted hashes and counts of the wanted rows (block, rid, c), packed; bucketed by class."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rid, c = (right.column(n).to_numpy() for n in ("rid", "c"))
        order = np.argsort(rid)
        at = np.searchsorted(rid[order], left.column("rid").to_numpy()).clip(0, max(len(rid) - 1, 0))
        hit = rid[order][at] == left.column("rid").to_numpy() if len(rid) else np.zeros(left.num_rows, bool)
        left, sets = left.filter(pa.array(hit)), []
        for i, j, buf, off in C.blocks(left.column("t")):
            row, g, count, _, _ = shingles(buf, off)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            sets += [g[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"c": pa.array(c[order][at[hit]] if len(rid) else c, pa.int64()), "set": pa.array(sets, pa.binary())})

    texts = table.select("block", "rid", F.col("row.text").alias("t"))
    sets = texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, "c long, set binary")
    return C.bucketed(sets.repartition(buckets, "c"), "sets", "c", buckets, "snappy")


def unset(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, _U, n), np.frombuffer(blob, np.uint32, n, 8 * n)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b)."""
    with_a = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [probability_jaccard(*unset(x.as_py()), *unset(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return with_b.mapInArrow(run, "a long, b long, similarity double")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each of SLOTS slots of their hash: a table of fixed size."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                h = np.concatenate([unset(x.as_py())[0] for x in batch.column(0).slice(lo, 256)])
                n += np.bincount((h & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        parts = n.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["k", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("data"))
        return pa.table({"k": table.column("k").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    rows = sets.select("set").mapInArrow(tally, "k long, data binary").groupBy("k").applyInArrow(add, "k long, data binary").collect()  # 64 rows
    found = {r["k"]: np.frombuffer(bytes(r["data"]), np.int64) for r in rows}
    return np.concatenate([found[k] for k in range(64)]) if found else np.zeros(SLOTS, np.int64)


def foreign_pairs(classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes (c, root) with different roots that can be similar, by prefix and position filters.

    Shingles are put in one order, rare ones first.  Linked sets share a shingle, and from their first shared one on each
    must still hold enough weight; a copy whose own edits already cost too much fails this with everyone.  The filters
    hold in any order that all sets follow, so counting by slots costs no pair: none that is similar enough is left out.
    """
    own = C.materialize(classes.join(sets, "c").select("c", "root", "set"), "split_sets", "snappy")
    common = slot_counts(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, root, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h, w = unset(blob)
                order = np.lexsort((h, common[(h & _U(SLOTS - 1)).astype(np.int64)]))
                h, w = h[order].view(np.int64), w[order].astype(np.int64)
                total = int(w.sum())
                rest = total - np.cumsum(w) + w
                met = (rest >= (similarity - SLACK) * total) & (common[(h.view(_U) & _U(SLOTS - 1)).astype(np.int64)] > 1)  # alone in its slot: no one shares it
                h, rest = h[met], rest[met]
                n = len(h)
                same = lambda x, kind: pa.array([x] * n, kind)  # noqa: B023, E731
                prev = pa.array(np.concatenate([h[:1], h[: n - 1]])[:n], mask=np.arange(n) == 0)
                cols = [pa.array(h[:n]), same(c, pa.int64()), same(root, pa.int64()), pa.array(rest[:n]), same(total, pa.int64()), same(bool((w == 1).all()), pa.bool_()), prev]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "c", "root", "rest", "total", "plain", "prev"])

    prefix = C.materialize(own.mapInArrow(run, "h long, c long, root long, rest long, total long, plain boolean, prev long"), "all_prefixes")
    # a shingle that one component alone puts first makes no pair; a hot one is split between tasks
    mixed = prefix.groupBy("h").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("h")
    prefix = C.materialize(prefix.join(C.materialize(mixed, "mixed_shingles"), "h"), "prefixes")
    other = prefix.select("h", *[F.col(x).alias(f"{x}_b") for x in ("c", "root", "rest", "total", "plain", "prev")])
    # with shares p and q of the weights still to come, the similarity is at most pq / (q + (1 - q) p), and the same turned round
    p, q, m = F.col("rest") / F.col("total"), F.col("rest_b") / F.col("total_b"), F.least("rest", "rest_b")
    may = F.least(p * q / (q + (1 - q) * p), p * q / (p + (1 - p) * q)) >= similarity - SLACK
    may &= ~(F.col("plain") & F.col("plain_b")) | (m >= (similarity - SLACK) * (F.col("total") + F.col("total_b") - m))
    # of a run of shared shingles only the first makes a row: it has the most weight still to come
    fresh = F.coalesce(F.col("prev") != F.col("prev_b"), F.lit(True))
    pairs = prefix.join(other, "h").where((F.col("c") < F.col("c_b")) & (F.col("root") != F.col("root_b")) & may & fresh)
    return pairs.select(F.col("c").alias("a"), F.col("c_b").alias("b")).distinct()


def class_links(classes: DataFrame, table: DataFrame, buckets: int, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (a, b, similarity) that connect every component, and the roots of their components.

    classes: (c, block, rid, bands), one row a class; table has the row (block, rid) with its text.
    """
    slots = classes.select("c", F.posexplode("bands").alias("band", "key"))
    # sums are written before rows are joined with them: a bucket with many rows is then split between tasks
    full = C.materialize(slots.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "full_buckets")
    shared = slots.join(full, ["band", "key"])
    # how many others a class meets over all bands: an unedited original meets more than its copies do
    mass = shared.groupBy("c").agg(F.sum("n").alias("mass"))
    members = C.materialize(shared.select("band", "key", "c").join(mass, "c").select("band", "key", "c", "mass"), "buckets")
    wanted = classes.select("c", "block", "rid").join(members.select("c").distinct(), "c", "left_semi").select("block", "rid", "c")
    sets = shingle_sets(table, wanted, buckets)
    links, roots, active = None, None, members
    tried = None
    for k in range(rounds):
        # first what meets most others, which bands mostly agree on; then any, another one in each band
        rank = F.struct((-F.col("mass") if k == 0 else F.xxhash64("c", "band", F.lit(k))).alias("order"), "c")
        centres = active.groupBy("band", "key").agg(F.min(rank)["c"].alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
        centres = C.materialize(centres, f"centres_{k}")
        stars = active.join(centres, ["band", "key"]).where("c <> centre")
        pairs = stars.select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = C.materialize(verified(pairs, sets), f"verified_{k}")
        tried = found if tried is None else tried.unionByName(found)
        links = tried.where(F.col("similarity") >= similarity)
        roots = C.materialize(components(links), f"roots_{k}")
        # a bucket goes on with the classes that are not in its centre's component
        of = roots.select(F.col("node").alias("c"), "root")
        labelled = stars.join(of, "c", "left").withColumn("root", F.coalesce("root", "c"))
        centre_of = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
        labelled = labelled.join(centre_of, "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
        active = C.materialize(labelled.where("root <> centre_root").select("band", "key", "c", "mass"), f"active_{k}")
        if active.isEmpty():
            break
    # what is left: pairs of one bucket in different components, as far as their shingles allow a link
    of = roots.select(F.col("node").alias("c"), "root")
    labelled = members.join(of, "c", "left").withColumn("root", F.coalesce("root", "c"))
    split = labelled.groupBy("band", "key").agg((F.min("root") < F.max("root")).alias("split"), F.count("*").alias("n")).where("split").drop("split")
    split = C.materialize(split, "split_keys")
    labelled = C.materialize(labelled.join(split, ["band", "key"]).select("band", "key", "c", "root", "n"), "split_buckets")
    few = labelled.where(F.col("n") <= FEW)
    other = few.select("band", "key", F.col("c").alias("b"), F.col("root").alias("root_b"))
    pairs = few.withColumnRenamed("c", "a").join(other, ["band", "key"]).where("a < b and root <> root_b").select("a", "b")
    pairs = pairs.unionByName(foreign_pairs(labelled.where(F.col("n") > FEW).select("c", "root").distinct(), sets, similarity)).distinct()
    found = C.materialize(verified(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), sets), "verified_rest").where(F.col("similarity") >= similarity)
    if not found.isEmpty():
        links = links.unionByName(found)
        roots = C.materialize(components(links), "roots_rest")
    return links, roots


def grouped(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The written table of sketched(), and (c, c2, head): the first document (late, id, block, rid) of each class's group."""
    table = sketched(docs)
    order = F.struct(F.col("row.doc_id").isNull().alias("late"), F.col("row.doc_id").alias("id"), "rid", "block")
    worded = table.where("words > 0").select("c", "c2", "bands", order.alias("place"))
    classes = C.materialize(worded.groupBy("c", "c2").agg(F.min("place").alias("first"), F.first("bands").alias("bands")), "classes")
    # a class is named by c; the rare classes that differ in c2 alone get names of their own
    clashes = C.materialize(classes.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c", F.lit(True).alias("clash")), "clashes")
    named = classes.withColumn("name", F.col("c"))
    if not clashes.isEmpty():
        named = classes.join(clashes, "c", "left").withColumn("name", F.when(F.col("clash"), F.xxhash64("c", "c2")).otherwise(F.col("c"))).drop("clash")
    _, roots = class_links(named.select(F.col("name").alias("c"), "first.block", "first.rid", "bands"), table, C.buckets_for(docs), similarity)
    rooted = named.join(roots.withColumnRenamed("node", "name"), "name", "left").select("c", "c2", "first", F.coalesce("root", "name").alias("root"))
    heads = C.materialize(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    return table, C.materialize(rooted.join(heads, "root").select("c", "c2", "head"), "verdicts")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of its group of near-duplicates, its own where it has none) and keep."""
    table, verdicts = grouped(docs.select("doc_id", "text"), similarity)
    worded = table.where("words > 0").select(F.col("row.doc_id").alias("doc_id"), "rid", "c", "c2").join(verdicts, ["c", "c2"])
    out = worded.select("doc_id", F.coalesce("head.id", "doc_id").alias("class_id"), (F.col("head.rid") == F.col("rid")).alias("keep"))
    blank = table.where("words = 0").select("row.doc_id", F.col("row.doc_id").alias("class_id"), F.lit(True).alias("keep"))
    return out.unionByName(blank)


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each group; texts are filtered where they lie."""
    table, verdicts = grouped(docs, similarity)
    rows = table.where("words > 0").select("c", "c2", "block", "rid")
    gone = rows.join(verdicts, ["c", "c2"]).where(F.col("head.rid") != F.col("rid")).select(F.col("block").alias("in_block"), F.col("rid").alias("gone"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return left.filter(pa.array(~np.isin(left.column("rid").to_numpy(), right.column("gone").to_numpy()))).select(["row"])

    kept = table.select("block", "rid", "row").groupBy("block").cogroup(gone.groupBy("in_block")).applyInArrow(run, T.StructType([table.schema["row"]]))
    return kept.select("row.*")
