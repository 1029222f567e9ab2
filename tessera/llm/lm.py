"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation, beside an add-one unigram.

Tokens are words with A-Z in lower case and one end a text.  Counts cover every training text.  All tokens counted
``MIN_COUNT`` times, and the ``SHORTLIST`` most frequent in any case, are contexts and outputs of the model, so it grows
with the input; rarer ones share ``BUCKETS`` outputs by surface form, within which a word has its add-one share (and
each bucket one share for words never seen).  The four tokens before, weighted by position,
predict a vector; a token's output is scored in three steps - its group of classes, its class, itself within the class -
each normalised by a matrix product over all alternatives, so the probabilities of all tokens sum to one.

Training texts are dealt by hash into rounds and parts whose number and size follow the corpus alone (``schedule``).
The parts of a round train copies over all their tokens from one
start, the mean of the round before, in which a row's copies count by how much they were trained.  Neither the files the
texts lie in nor Arrow's batches have a say.  Counts of rare words never meet the driver: (word, document) entries travel in packed blocks, dealt
by ranges of the word's hash, and come back as one number a document.

Null and empty texts are a single end.  Rows with a null id are scored, not learnt from, and not held out.  Equal rows
get equal scores.  Without any training text both scores are log10 of 1 a token.  An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SHORTLIST, MIN_COUNT, BUCKETS, CONTEXT, WIDTH = 1984, 50, 64, 4, 16
NOISE, CLASS_NOISE, BATCH, RATE = 2, 24, 4096, 0.15
FOLDS, HELD_OUT = 7, 2
#: Text bytes and documents that one packed block covers.
BLOCK_TEXT, BLOCK_DOCS = 24 << 20, 20_000
#: Most rounds; training tokens of a part, at least, and for each output, so that the copies stay small beside the texts.
ROUNDS, PART_TOKENS, PART_SHARE = 8, 1 << 20, 16
#: Entries of a noise table.
TABLE = 1 << 10
#: Rows of a parameter that travel together when copies are averaged.
SLICE = 1 << 15
#: Scores of outputs held at once while probabilities are normalised; tokens of one class that are scored together.
SCORES, LANES = 1 << 17, 32
#: Scores between which their exponentials are summed as they are.
PLAIN = 80

_U = np.uint64
END_HASH = _U(0x1D8E4E27C47D124F)


# ---------------------------------------------------------------- tokens
_SIZES = np.digitize(np.arange(11), (4, 7, 10)) * 16


def tokens(buf: np.ndarray, off: np.ndarray):
    """Hash, bucket and document row of every word of a block."""
    buf = C.lower_ascii(buf)
    start, end, doc = C.word_spans(buf, off)
    h = C.word_hashes(buf, start, end)
    if not len(h):
        return h, np.zeros(0, np.int64), doc
    beyond = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf >= 128, out=beyond[1:])
    letter = (buf >= 97) & (buf <= 122) | (buf >= 128)
    size = end - start
    last = letter[end - 1]
    tail = np.where(last | (size == 1), buf[end - 1], buf[np.maximum(end - 2, start)])  # last byte but for one mark
    bucket = _SIZES[np.minimum(size, 10)] + (beyond[end] > beyond[start]) * 8 + last * 4 + (tail >> 1 & 3)
    return h, bucket.astype(np.int64), doc


def training(doc_ids: list) -> np.ndarray:
    return np.array([d is not None and zlib.crc32(str(d).encode()) % FOLDS != HELD_OUT for d in doc_ids], bool)


def summed(h: np.ndarray, n: np.ndarray, extra: np.ndarray):
    """Distinct sorted hashes, their summed counts and one of their extras."""
    order = np.argsort(h, kind="stable")
    h, n, extra = h[order], n[order], extra[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n, extra[at]


def own_outputs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the tokens with outputs of their own, by falling count: the first SHORTLIST and all of MIN_COUNT."""
    order = np.lexsort((h, -n))
    return order[: max(SHORTLIST, int((n >= MIN_COUNT).sum()))]


# ---------------------------------------------------------------- counts
def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """One row a part: its tokens, its distinct words, (c + 1) summed by bucket, and its words that may have outputs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n, b = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            own, cut = C.part_cuts(h, parts)
            blobs = [C.pack(h[i:j], n[i:j].astype(np.uint32), b[i:j].astype(np.uint8)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "data"])

        for batch in batches:
            learn = training(batch.column(0).to_pylist())
            for i, j, buf, off in C.blocks(batch.column(1)):
                h, b, doc = tokens(buf, off)
                keep = learn[i:j][doc] if len(h) else np.zeros(0, bool)
                ends = int(learn[i:j].sum())
                h = np.append(h[keep], END_HASH)
                held.append(summed(h, np.append(np.ones(len(h) - 1, np.int64), ends), np.append(b[keep], 0)))
                size += len(buf)
                if size >= BLOCK_TEXT:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        h, n, b = (np.concatenate(x) for x in zip(*(C.unpack(d.as_py(), _U, np.uint32, np.uint8) for d in table.column("data")), strict=True))
        h, n, b = summed(h, n.astype(np.int64), b)
        h, n, b = h[n > 0], n[n > 0], b[n > 0]
        top = own_outputs(h, n)
        inner = h != END_HASH
        sums = np.bincount(b[inner], n[inner] + 1.0, minlength=BUCKETS)
        return pa.table({"n": [int(n.sum())], "v": [len(h)], "sums": [sums.tolist()], "top": [C.pack(h[top], n[top], b[top])]}, schema=pa.schema([("n", pa.int64()), ("v", pa.int64()), ("sums", pa.list_(pa.float64())), ("top", pa.binary())]))

    packed = docs.mapInArrow(count, "part long, data binary")
    return packed.groupBy("part").applyInArrow(total, "n long, v long, sums array<double>, top binary")


class Vocabulary:
    """Shortlist by falling count, then the buckets; what the counts say of them."""

    def __init__(self, rows: Iterator):
        self.n, self.v, sums = 0, 0, np.zeros(BUCKETS)
        often, few = [], (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        for r in rows:  # of the words below MIN_COUNT no more than one part's and the best so far are held
            self.n, self.v, sums = self.n + r["n"], self.v + r["v"], sums + np.array(r["sums"])
            own = C.unpack(bytes(r["top"]), _U, np.int64, np.uint8)
            enough = own[1] >= MIN_COUNT
            often.append([x[enough] for x in own])
            few = [np.concatenate([x, y[~enough]]) for x, y in zip(few, own, strict=True)]
            best = own_outputs(few[0], few[1])
            few = [x[best] for x in few]
        h, c, b = (np.concatenate(x) for x in zip(*often, few, strict=True))
        order = own_outputs(h, c)
        h, c, b = h[order], c[order], b[order]
        inner = h != END_HASH
        self.bucket_sums = np.maximum(sums - np.bincount(b[inner], c[inner] + 1.0, minlength=BUCKETS), 0) + 1
        if len(h) and inner.all():  # the end always has an output of its own
            h, c = np.append(h, END_HASH), np.append(c, 0)
        self.h, self.c = h, c
        self.size = len(h)
        order = np.argsort(h)
        self.sorted, self.id_of, self.starts = h[order], order, None
        self.end = int(np.flatnonzero(h == END_HASH)[0]) if len(h) else 0
        self.unigram = np.concatenate([c + 1.0, self.bucket_sums]) if len(h) else self.bucket_sums
        self.unigram = self.unigram / self.unigram.sum()

    def ids(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Looked up from where the hashes of one's leading bits start: hashes are spread evenly, so few steps are left."""
        if not self.size:
            return bucket
        bits = self.size.bit_length() + 2
        if self.starts is None:
            self.starts = np.append(0, np.cumsum(np.bincount(self.sorted >> _U(64 - bits), minlength=1 << bits))).astype(np.int32)
        at = np.minimum(self.starts[h >> _U(64 - bits)], self.size - 1)
        behind = np.flatnonzero(self.sorted[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] < self.size - 1]
            behind = behind[self.sorted[at[behind]] < h[behind]]
        at = np.minimum(at, self.size - 1)
        return np.where(self.sorted[at] == h, self.id_of[at], self.size + bucket)

    def stream(self, h: np.ndarray, bucket: np.ndarray, doc: np.ndarray, docs: int):
        """Ids of all tokens, ends included, and their context ids (tokens, CONTEXT); document row of each."""
        words = np.bincount(doc, minlength=docs)
        last = np.cumsum(words + 1) - 1
        out = np.empty(len(h) + docs, np.int64)
        is_end = np.zeros(len(out), bool)
        is_end[last] = True
        out[is_end] = self.end
        out[~is_end] = self.ids(h, bucket)
        row = np.repeat(np.arange(docs), words + 1)
        place = np.arange(len(out)) - (last - words)[row]
        none = self.size + BUCKETS
        context = np.full((len(out), CONTEXT), none, np.int64)
        for j in range(1, CONTEXT + 1):
            context[j:, j - 1] = np.where(place[j:] >= j, out[:-j], none) if j < len(out) else none
        return out, context, row


# ---------------------------------------------------------------- the model
class LogBilinear:
    """Outputs in a tree of three levels, by falling frequency: groups of classes (T, t), classes (S, s), tokens (R, r).

    Each level has about the cube root of the outputs to choose from.  Word inputs are Q, position weights P.
    """

    def __init__(self, unigram: np.ndarray):
        m = len(unigram)
        self.m, self.per = m, max(2, int(np.ceil(m ** (1 / 3))))
        order = np.argsort(-unigram, kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        mass = [unigram[order] / unigram.sum()]
        for _ in range(2):
            mass.append(np.add.reduceat(mass[-1], np.arange(0, len(mass[-1]), self.per)))
        self.noise = {"R": mass[0] / np.repeat(mass[1], self.per)[:m], "S": mass[1] / np.repeat(mass[2], self.per)[: len(mass[1])], "T": mass[2]}
        rng = np.random.default_rng(7)
        self.seen: dict[str, np.ndarray] = {}
        self.p = {"Q": rng.normal(0, 0.1, (m + 1, WIDTH)).astype(np.float32), "P": np.full((CONTEXT, WIDTH), 0.5, np.float32)}
        for k in "RST":
            self.p[k] = rng.normal(0, 0.1, (len(self.noise[k]), WIDTH)).astype(np.float32)
            self.p[k.lower()] = np.log(self.noise[k]).astype(np.float32)

    def state(self) -> tuple[dict, dict]:
        return self.p, self.seen

    def load(self, state: tuple[dict, dict] | None) -> LogBilinear:
        """A copy of a state; None leaves the start as it is."""
        if state:
            self.p, self.seen = ({k: v.copy() for k, v in x.items()} for x in state)
        return self

    def predict(self, context: np.ndarray) -> np.ndarray:
        return self.predicted(context, *running(context))[0]

    def predicted(self, context: np.ndarray, line: np.ndarray, odd: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Predictions, and the inputs of the line: a token's input is read once, though it is context of CONTEXT others."""
        Q, P, n = self.p["Q"], self.p["P"], len(context)
        inputs = np.take(Q, line, axis=0)
        q = inputs[CONTEXT - 1 :] * P[0]
        for j in range(1, CONTEXT):
            q += inputs[CONTEXT - 1 - j : CONTEXT - 1 - j + n] * P[j]
        some = np.unique(np.concatenate(odd))
        if len(some):
            q[some] = sum(np.take(Q, context[some, j], axis=0) * P[j] for j in range(CONTEXT))
        return q, inputs

    def trainer(self):
        """step(context, target): one noise-contrastive step, each row's step scaled by its past gradients.

        Only rows that a step touches cost it anything, so its time does not grow with the vocabulary.
        """
        rng = np.random.default_rng(11)
        if not self.seen:
            self.seen = {k: np.full(len(v), 1e-8, np.float32) for k, v in self.p.items()}
        seen = self.seen
        hit = {k: np.zeros(len(self.p[k]), bool) for k in "QRST"}
        slot = {k: np.zeros(len(self.p[k]), np.int32) for k in "QRST"}
        # noise by table lookup: equal shares of the cumulated distribution, of all groups or of what lies below one parent
        grid = (np.arange(TABLE) + 0.5) / TABLE
        top_table = np.searchsorted(np.cumsum(self.noise["T"]), grid).clip(0, len(self.noise["T"]) - 1)
        tables = {}
        for k in "SR":
            starts = range(0, len(self.noise[k]), self.per)
            tables[k] = np.stack([(lo + np.searchsorted(np.cumsum(w), grid).clip(0, len(w) - 1)).astype(np.int32) for lo in starts for w in [self.noise[k][lo : lo + self.per]]])
        log_noise = {k: np.log((CLASS_NOISE if k == "T" else NOISE) * self.noise[k]).astype(np.float32) for k in "RST"}

        def move(k: str, at, g: np.ndarray) -> None:
            seen[k][at] += g * g if g.ndim == 1 else np.einsum("rd,rd->r", g, g) / WIDTH
            scale = RATE / np.sqrt(seen[k][at])
            self.p[k][at] -= g * (scale if g.ndim == 1 else scale[:, None])

        def rows(k: str, bias: str | None, at: np.ndarray, g: np.ndarray, gb: np.ndarray | None = None) -> None:
            hit[k][at] = True
            own = np.flatnonzero(hit[k])
            hit[k][own] = False
            slot[k][own] = np.arange(len(own))
            place = slot[k][at].astype(np.int64)
            total = np.zeros(len(own) * WIDTH, np.float32)
            np.add.at(total, (place[:, None] * WIDTH + np.arange(WIDTH)).reshape(-1), g.reshape(-1))  # one-dimensional: the fast path
            move(k, own, total.reshape(-1, WIDTH))
            if bias:
                move(bias, own, np.bincount(place, gb, minlength=len(own)).astype(np.float32))

        def contrast(q: np.ndarray, k: str, right: np.ndarray, share: np.float32):
            """Gradient for q, and rows and gradients of the true output and of NOISE noise outputs below the same parent."""
            wrong = tables[k][(right // self.per)[:, None], rng.integers(0, TABLE, (len(right), NOISE))]
            at = np.concatenate([right[:, None], wrong], 1)
            vec = np.take(self.p[k], at, axis=0)
            g = sigmoid(np.einsum("bd,bkd->bk", q, vec) + (np.take(self.p[k.lower()], at) - np.take(log_noise[k], at)))
            g[:, 0] -= 1
            g *= share
            return np.einsum("bk,bkd->bd", g, vec), at.reshape(-1), (g[:, :, None] * q[:, None, :]).reshape(-1, q.shape[1]), g.reshape(-1)

        def step(context: np.ndarray, target: np.ndarray) -> None:
            share = np.float32(1 / len(target))
            line, odd = running(context)
            q, inputs = self.predicted(context, line, odd)
            word = self.rank[target]
            cls = word // self.per
            top = cls // self.per
            noise = top_table[rng.integers(0, TABLE, CLASS_NOISE)]  # shared by the batch: one matrix product
            T, t = self.p["T"], self.p["t"] - log_noise["T"]
            own = np.take(T, top, axis=0)
            true = (sigmoid(np.einsum("bd,bd->b", q, own) + t[top]) - 1) * share
            false = sigmoid(q @ T[noise].T + t[noise]) * share
            back = true[:, None] * own + false @ T[noise]
            moves = [("T", np.concatenate([top, noise]), np.concatenate([true[:, None] * q, false.T @ q]), np.concatenate([true, false.sum(0)]))]
            for k, right in (("S", cls), ("R", word)):
                more, *rest = contrast(q, k, right, share)
                back += more
                moves.append((k, *rest))
            position, n = np.empty_like(self.p["P"]), len(target)
            ids, parts = [line], [np.zeros_like(inputs)]
            for j in range(CONTEXT):  # steps of a token's input are summed along the line before they are summed by token
                own, g = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + n), back * self.p["P"][j]
                position[j] = np.einsum("bd,bd->d", back, inputs[own])
                if len(odd[j]):
                    at = context[odd[j], j]
                    position[j] += np.einsum("bd,bd->d", back[odd[j]], np.take(self.p["Q"], at, axis=0) - inputs[own][odd[j]])
                    ids.append(at)
                    parts.append(g[odd[j]])
                    g[odd[j]] = 0
                parts[0][own] += g
            rows("Q", None, np.concatenate(ids), np.concatenate(parts))
            move("P", slice(None), position)
            for k, at, g, gb in moves:
                rows(k, k.lower(), at, g, gb)

        return step

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of every target: at each level, a matrix product over all alternatives."""
        word = self.rank[target]
        cls = word // self.per
        few = len(self.p["S"]) <= 1 << 16
        order = np.argsort(cls.astype(np.uint16) if few else cls, kind="stable")  # what shares a class, and a group of classes, lies together
        word = word[order]
        rows = np.take(self.predict(context), order, axis=0)
        q = np.ascontiguousarray(rows.T)
        out = np.zeros(len(word))
        for k, own in (("T", word // self.per**2), ("S", word // self.per), ("R", word)):
            parent = own // self.per if k != "T" else np.zeros(len(own), np.int64)
            cut = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(own) else own
            end = np.append(cut[1:], len(own))
            if k == "R":  # very many small groups of alternatives: all but the last, which may be shorter, go together
                whole = parent[cut] < len(self.p["R"]) // self.per
                self.tiled(rows, word, cut[whole], end[whole], out)
                cut, end = cut[~whole], end[~whole]
            for a, b in zip(cut, end, strict=True):
                lo = int(parent[a]) * self.per if k != "T" else 0
                hi = lo + self.per if k != "T" else len(self.p["T"])
                W, w = self.p[k][lo:hi], self.p[k.lower()][lo:hi, None]
                step = max(64, SCORES // len(W))  # scores held at once
                for i in range(a, b, step):
                    j = min(b, i + step)
                    z = W @ q[:, i:j] + w
                    mine = z[own[i:j] - lo, np.arange(j - i)].astype(np.float64)
                    out[i:j] += mine - log_sum(z, 0)
        back = np.empty(len(out))
        back[order] = out
        return back

    def tiled(self, q: np.ndarray, word: np.ndarray, cut: np.ndarray, end: np.ndarray, out: np.ndarray) -> None:
        """Adds to out what tokens lack within their class: runs of one class in tiles of LANES tokens, many products at once."""
        per, count = self.per, -(-(end - cut) // LANES)
        at = np.repeat(cut, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * LANES
        size, cls = np.minimum(np.repeat(end, count) - at, LANES), np.repeat(word[cut] // per, count)
        W = self.p["R"][: len(self.p["R"]) // per * per].reshape(-1, per, WIDTH)
        w = self.p["r"][: len(W) * per].reshape(-1, per, 1)
        lane = np.arange(LANES)
        step = max(1, SCORES // (per * LANES))
        for i in range(0, len(at), step):
            j = min(len(at), i + step)
            there = np.minimum(at[i:j, None] + lane, len(word) - 1)  # lanes beyond a tile's size are not read
            z = np.matmul(W[cls[i:j]], np.take(q, there, axis=0).transpose(0, 2, 1))
            z += w[cls[i:j]]
            used = np.flatnonzero((lane < size[i:j, None]).reshape(-1))
            own = there.reshape(-1)[used]
            tile, place = used // LANES, used % LANES
            mine = z[tile, word[own] - cls[i + tile] * per, place].astype(np.float64)
            out[own] += mine - log_sum(z, 1).reshape(-1)[used]


def running(context: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The line of tokens that contexts slide over, and for each position the rows whose context differs from it (starts of texts)."""
    n = len(context)
    line = np.concatenate([context[0, :0:-1], context[:, 0]]) if n else np.zeros(CONTEXT - 1, np.int64)
    return line, [np.flatnonzero(context[:, j] != line[CONTEXT - 1 - j : CONTEXT - 1 - j + n]) for j in range(CONTEXT)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_sum(z: np.ndarray, axis: int) -> np.ndarray:
    """Log of the summed exponentials along an axis; z is overwritten."""
    if z.size and z.max() < PLAIN and z.min() > -PLAIN:
        return np.log(np.exp(z, out=z).sum(axis))
    top = z.max(axis, keepdims=True)
    z -= top
    return top.squeeze(axis) + np.log(np.exp(z, out=z).sum(axis))


def schedule(tokens: int, outputs: int) -> tuple[int, int]:
    """(rounds, parts a round) for so many training tokens: both depend on the corpus alone.

    Up to ROUNDS rounds; the parts of a round grow with the square root of the corpus, and so do the tokens of a part:
    a larger corpus trains each copy longer between two averages.
    """
    least = max(PART_TOKENS, PART_SHARE * outputs)
    rounds = min(ROUNDS, max(1, -(-tokens // least)))
    return rounds, max(1, min(int(np.ceil(np.sqrt(tokens / PART_TOKENS))), -(-tokens // (rounds * least))))


def trained(docs: DataFrame, vocabulary: Vocabulary, batch: int = BATCH) -> tuple[dict, dict] | None:
    """State of the model after all rounds; None without training texts."""
    spark = docs.sparkSession
    if not vocabulary.n:
        return None
    rounds, parts = schedule(vocabulary.n, vocabulary.size)
    h = F.xxhash64("doc_id", "text")
    own = docs.where(F.col("doc_id").isNotNull() & (C.crc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT))
    own = own.select("doc_id", "text", h.alias("h"), F.pmod(h, F.lit(rounds * parts)).cast("int").alias("part"))
    path = C.scratch(spark, "lm_rounds")
    own.withColumn("round", F.floor(F.col("part") / parts).cast("int")).write.partitionBy("round").option("compression", "zstd").parquet(path)
    state = None
    for k in range(rounds):
        texts = spark.read.schema("doc_id long, text string, h long, part int, round int").parquet(path).where(F.col("round") == k)
        # a part is one task's, in an order of its own
        dealt = texts.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("h", "doc_id", "text").select(F.col("part").cast("long"), "text")
        state = averaged(dealt, vocabulary, state, batch) or state
        del texts, dealt  # the round is over: its texts and shuffles are read no more
        C.delete(spark, f"{path}/round={k}")
        C.let_shuffles_go(spark)
    C.delete(spark, path)
    return state


def averaged(texts: DataFrame, vocabulary: Vocabulary, start: tuple[dict, dict] | None, batch: int) -> tuple[dict, dict] | None:
    """Mean of the copies that the parts of texts (part, text; part after part) train from one start."""
    schema = "k string, lo long, part long, p binary, gained binary"

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model, step, base, rest = None, None, None, None, []

        def feed(last: bool) -> None:
            """Steps of exactly ``batch`` tokens, whatever came together; the rest of a part is its last step."""
            context, target = (np.concatenate(x) for x in zip(*rest, strict=True))
            end = len(target) if last else len(target) // batch * batch
            for lo in range(0, end, batch):
                step(context[lo : min(lo + batch, end)], target[lo : min(lo + batch, end)])
            rest[:] = [] if last else [(context[end:], target[end:])]

        def copies() -> Iterator[pa.RecordBatch]:
            if rest:
                feed(True)
            for k, v in model.p.items():
                for lo in range(0, len(v), SLICE):
                    own = slice(lo, lo + SLICE)
                    row = [[k], [lo], [now], [v[own].tobytes()], [(model.seen[k][own] - base[k][own]).tobytes()]]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["k", "lo", "part", "p", "gained"])

        for records in batches:
            part = records.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    if model:
                        yield from copies()
                    now, model = int(part[a]), LogBilinear(vocabulary.unigram).load(start)
                    step = model.trainer()
                    base = {k: v.copy() for k, v in model.seen.items()}
                for i, j, buf, off in C.blocks(records.column(1).slice(a, b - a)):
                    target, context, _ = vocabulary.stream(*tokens(buf, off), j - i)
                    rest.append((context, target))
                    feed(False)
        if model:
            yield from copies()

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        k, lo = table.column("k")[0].as_py(), table.column("lo")[0].as_py()
        total, weight, square, first = 0.0, 0.0, 0.0, None
        for x, w in zip(table.column("p"), table.column("gained"), strict=True):
            w = np.frombuffer(w.as_py(), np.float32).astype(np.float64)
            x = np.frombuffer(x.as_py(), np.float32).reshape(len(w), -1)
            first = x if first is None else first
            total, weight, square = total + x * w[:, None], weight + w, square + w * w
        some = weight > 0  # a row that no copy touched is still the start's
        x = np.where(some[:, None], total / np.where(some, weight, 1)[:, None], first).astype(np.float32)
        gained = (square / np.where(some, weight, 1)).astype(np.float32)
        return pa.table({"k": [k], "lo": [lo], "p": pa.array([x.tobytes()], pa.binary()), "gained": pa.array([gained.tobytes()], pa.binary())}, schema=pa.schema([("k", pa.string()), ("lo", pa.int64()), ("p", pa.binary()), ("gained", pa.binary())]))

    slices = texts.mapInArrow(train, schema).groupBy("k", "lo").applyInArrow(mean, "k string, lo long, p binary, gained binary")
    model = LogBilinear(vocabulary.unigram).load(start)
    model.trainer()
    for r in slices.toLocalIterator():
        gained = np.frombuffer(bytes(r["gained"]), np.float32)
        own = slice(r["lo"], r["lo"] + len(gained))
        model.p[r["k"]][own] = np.frombuffer(bytes(r["p"]), np.float32).reshape(model.p[r["k"]][own].shape)
        model.seen[r["k"]][own] += gained
    return model.state()


# ---------------------------------------------------------------- scoring
def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = C.parts_for(docs, 12)
    vocabulary = Vocabulary(word_counts(docs, parts).toLocalIterator())
    state = trained(docs, vocabulary)
    parameters = (state[0], {}) if state else None
    total, distinct = vocabulary.n, vocabulary.v
    floor = np.log10(total + distinct + 1.0)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with all that the shortlist and the model say, and packed entries of their other words."""
        from pyspark import TaskContext

        model = LogBilinear(vocabulary.unigram).load(parameters)
        shortlist = np.append(np.log10(vocabulary.c + 1.0), np.zeros(BUCKETS)) if vocabulary.size else np.zeros(BUCKETS)
        known = np.append(vocabulary.c > 0, np.zeros(BUCKETS, bool)) if vocabulary.size else np.zeros(BUCKETS, bool)
        share = np.append(np.zeros(vocabulary.size), np.log10(vocabulary.bucket_sums))
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = docs_held = 0

        def flush() -> pa.RecordBatch:
            ids, tok, kn, base, score = (np.concatenate([x[k] for x in held]) if k else sum((x[0] for x in held), []) for k in range(5))
            h, doc, n = (np.concatenate([x[k] for x in held]) for k in (5, 6, 7))
            order = np.argsort(h, kind="stable")
            h, doc, n = h[order], doc[order], n[order]
            learn = training(ids)
            own, cut = C.part_cuts(h, parts)
            blobs = [C.pack(h[i:j], doc[i:j].astype(np.uint16), np.minimum(n[i:j], 2**32 - 1).astype(np.uint32), learn[doc[i:j]].view(np.uint8)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            k, d = len(own), len(ids)
            empty = lambda n, kind: pa.nulls(n, kind)
            cols = {
                "part": pa.chunked_array([pa.array(own, pa.int64()), empty(d, pa.int64())]),
                "block": pa.array(np.full(k + d, block), pa.int64()),
                "data": pa.chunked_array([pa.array(blobs, pa.binary()), empty(d, pa.binary())]),
                "i": pa.chunked_array([empty(k, pa.int32()), pa.array(np.arange(d), pa.int32())]),
                "doc_id": pa.chunked_array([empty(k, pa.int64()), pa.array(ids, pa.int64())]),
            }
            for name, x, kind in (("n_tokens", tok, pa.int64()), ("n_known", kn, pa.int64()), ("base", base, pa.float64()), ("score", score, pa.float64())):
                cols[name] = pa.chunked_array([empty(k, kind), pa.array(x, kind)])
            return pa.table(cols).combine_chunks().to_batches()[0]

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, off in C.blocks(batch.column(1)):
                for i in range(lo, hi, BLOCK_DOCS):  # a block's rows fit its entries' 16 bits
                    j = min(hi, i + BLOCK_DOCS)
                    if held and (docs_held + j - i > BLOCK_DOCS or size >= BLOCK_TEXT):
                        yield flush()
                        held.clear()
                        block, size, docs_held = block + 1, 0, 0
                    h, bucket, doc = tokens(buf[off[i - lo] : off[j - lo]], off[i - lo : j - lo + 1] - off[i - lo])
                    target, context, row = vocabulary.stream(h, bucket, doc, j - i)
                    logp = model.log_prob(context, target) / np.log(10) - share[target]
                    by = lambda x: np.bincount(row, x, minlength=j - i)  # noqa: B023, E731
                    ends = np.cumsum(np.bincount(doc, minlength=j - i) + 1) - 1
                    rare = np.delete(target, ends) >= vocabulary.size
                    g, d = h[rare], doc[rare]
                    order = np.argsort(g, kind="stable")  # rows rise within a word
                    g, d = g[order], d[order]
                    cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))) if len(g) else np.zeros(0, np.int64)
                    n = np.diff(np.append(cut, len(g)))
                    held.append((ids[i:j], by(None).astype(np.int64), by(known[target].astype(float)).astype(np.int64), by(shortlist[target]), by(logp), g[cut], d[cut] + docs_held, n))
                    size, docs_held = size + len(buf), docs_held + j - i
        if held:
            yield flush()

    def rare(table: pa.Table) -> pa.Table:
        """Counts of a part's words from the entries themselves; sums of log10(c + 1) and known tokens by document."""
        blocks = table.column("block").to_numpy()
        h, doc, n, learn = (np.concatenate(x) for x in zip(*(C.unpack(d.as_py(), _U, np.uint16, np.uint32, np.uint8) for d in table.column("data")), strict=True))
        sizes = np.array([len(d.as_py()) // 15 for d in table.column("data")])
        which = np.repeat(np.arange(len(blocks)), sizes)
        order = np.argsort(h, kind="stable")
        own = h[order]
        new = np.append(True, own[1:] != own[:-1])
        c = np.add.reduceat((n * learn.astype(np.int64))[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        count = np.empty(len(h), np.int64)
        count[order] = c
        key = which * 65536 + doc
        keys, inverse = np.unique(key, return_inverse=True)
        x = np.bincount(inverse, n * np.log10(count + 1.0))
        k = np.bincount(inverse, n * (count > 0))
        cut = np.searchsorted(keys, np.arange(len(blocks) + 1) * 65536)
        blobs = [C.pack((keys[i:j] % 65536).astype(np.uint16), x[i:j], k[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"block": pa.array(blocks, pa.int64()), "sums": pa.array(blobs, pa.binary())})

    def final(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("i")
        x, k = np.zeros(left.num_rows), np.zeros(left.num_rows)
        for d in right.column("sums"):
            at, own, kn = C.unpack(d.as_py(), np.uint16, np.float64, np.float64)
            x[at] += own
            k[at] += kn
        n = left.column("n_tokens").to_numpy()
        ids = left.column("doc_id")
        held = np.array([d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in ids.to_pylist()], bool)
        base = left.column("base").to_numpy() + x - n * floor
        score = left.column("score").to_numpy() + x if total else base
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": n, "n_known": left.column("n_known").to_numpy() + k.astype(np.int64), "train_tokens": np.full(len(n), total), "base_score": base, "score": score})

    schema = "part long, block long, data binary, i int, doc_id long, n_tokens long, n_known long, base double, score double"
    table = C.materialize(docs.mapInArrow(first, schema), "lm_blocks", "lz4")
    sums = table.where("part is not null").select("part", "block", "data").groupBy("part").applyInArrow(rare, "block long, sums binary")
    left = table.where("part is null").select("block", "i", "doc_id", "n_tokens", "n_known", "base", "score")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return left.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(final, out)
