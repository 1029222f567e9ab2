"""Conversation repair: the cheapest edits that give a conversation's turns a regular structure, and their audit.

Of a conversation's rows by turn (nulls first; ties by role, then by the text's first 64 characters, then by its SHA-256),
each row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (the last
character that is not white space is none of ``.!?``).  Edits: K(eep) 0, R(ename the role to user or assistant) 1,
D(elete) 2, the only edit of blank and duplicate rows, and I(nsert an empty user or assistant turn) 5, before a row or at
the end; a truncated row that stays costs 5 more.  The roles' initials that remain must read ``(s?(ua)+)?``.  Of the
cheapest edit strings the ASCII-least is the audit.

The structure has four states: nothing yet, after s, after u, after a.  What the rows so far cost to reach each state is a
vector of four numbers; less its least entry it is one of a few dozen, since entries that another one beats by more than
later rows can make good are struck out.  These vectors are the states of a deterministic automaton that is built when
needed: a transition is worked out once and looked up ever after (`Automaton`).  A forward scan of the table gives the
cost, and a backward trace along tight arcs, those that lie on a cheapest path, gives the audit.  Reading the first letters
decides every tie: no edit string of the same rows is the beginning of another one that ends with the same row's edit.

Rows are sorted by ranges, so a long conversation lies in many parts, and only numbers of its rows (no texts) are scanned,
part by part.  Where a conversation reaches a part's edge the scan gives, for each pair of states, the cost and the least
edit string between them; these tables are put together per conversation (one row a part).  The repaired turns are read
off in a stream by conversation, whose memory does not grow with it; its SHA-256 has to be taken in that order.

Null roles and texts are one space; a null ``conv_id`` is a conversation of its own; rows with null turns come first.
Identical rows are duplicates of the first.  Empty and very long texts are like any others.  An empty table gives an empty
result, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common as C

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, RENAME, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
FAR = 1 << 40
#: Classes of roles by initial, and faults.
OTHER = 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = ("blank", "duplicate", "truncated")
WHITE = " \t\n\x0b\x0c\r"
PART_MB = 16


# ---------------------------------------------------------------- the automaton
def symbol(fault: int, role: int) -> int:
    """What a row is to the automaton: 0 must go; else its role's class and whether it is truncated."""
    return 0 if fault in (BLANK, DUPLICATE) else 1 + 2 * role + (fault == TRUNCATED)


def _after(state: int, initial: str) -> int | None:
    """The state behind one more turn, if it may follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _arcs(sym: int) -> list[list[tuple[int, str] | None]]:
    """(cost, edits) of the best way over one row from state to state: insertions, then the row's edit."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]

    def offer(a: int, b: int | None, cost: int, edits: str) -> None:
        if b is not None and (best[a][b] is None or (cost, edits) < best[a][b]):
            best[a][b] = (cost, edits)

    for a in STATES:
        here, cost, edits = a, 0, ""
        while len(edits) < 3:
            offer(a, here, cost + DELETE, edits + "D")
            if sym:
                role, extra = (sym - 1) // 2, CUT_SHORT * ((sym - 1) % 2)
                if role != OTHER:
                    offer(a, _after(here, "sua"[role]), cost + KEEP + extra, edits + "K")
                for to in "ua":
                    offer(a, _after(here, to), cost + RENAME + extra, edits + "R")
            here, cost, edits = (ASSISTANT if here == USER else USER), cost + INSERT, edits + "I"
    return best


ARCS = [_arcs(s) for s in range(9)]
#: Insertions that end a conversation in each state.
TAIL = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


class Automaton:
    """Vectors of costs as states; transitions and tight arcs are found once and kept."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self._next: list[int] = []
        self._shift: list[int] = []
        self._tight: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.begin = [self._state([0 if q == at else FAR for q in STATES])[0] for at in STATES]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The automaton's state of a vector, and what was taken off."""
        least = min(costs)
        v = [c - least if c < FAR else FAR for c in costs]
        if v[START] > v[ASSISTANT] + DELETE:  # all that the start can do more is to keep an s instead of deleting it
            v[START] = FAR
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = FAR
        key = tuple(v)
        if key not in self._ids:
            self._ids[key] = len(self.vectors)
            self.vectors.append(key)
            self._next += [-1] * len(ARCS)
            self._shift += [0] * len(ARCS)
        return self._ids[key], least

    def _advance(self, state: int, sym: int) -> int:
        v, arcs = self.vectors[state], ARCS[sym]
        costs = [min([v[a] + arcs[a][b][0] for a in STATES if arcs[a][b] and v[a] < FAR], default=FAR) for b in STATES]
        to, shift = self._state(costs)
        self._next[state * len(ARCS) + sym], self._shift[state * len(ARCS) + sym] = to, shift
        return to

    def scan(self, symbols: bytes, state: int) -> tuple[list[int], int]:
        """The states before and behind every row, and the sum of what was taken off."""
        path, total, width = [state], 0, len(ARCS)
        table, shifts = self._next, self._shift
        for s in symbols:
            to = table[state * width + s]
            if to < 0:
                to = self._advance(state, s)
            total += shifts[state * width + s]
            path.append(to)
            state = to
        return path, total

    def _back(self, state: int, sym: int, useful: int) -> tuple[int, tuple[int, ...]]:
        """Which entries before a row lead to a useful one behind it at no loss, and where each goes by its least edits."""
        v, arcs = self.vectors[state], ARCS[sym]
        behind, shift = self.vectors[self._next[state * len(ARCS) + sym]], self._shift[state * len(ARCS) + sym]
        mask, to = 0, [-1] * 4
        for a in STATES:
            ways = [(arcs[a][b][1], b) for b in STATES if useful >> b & 1 and arcs[a][b] and v[a] < FAR and v[a] + arcs[a][b][0] == behind[b] + shift]
            if ways:
                mask, to[a] = mask | 1 << a, min(ways)[1]
        return mask, tuple(to)

    def trace(self, symbols: bytes, path: list[int], useful: int) -> list[tuple[int, ...]]:
        """Of every row, where each entry before it goes on a cheapest way to a useful entry of the end."""
        out: list[tuple[int, ...]] = [()] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            key = (path[i] * len(ARCS) + symbols[i]) << 4 | useful
            found = self._tight.get(key)
            if found is None:
                found = self._tight[key] = self._back(path[i], symbols[i], useful)
            useful, out[i] = found
        return out

    @staticmethod
    def read(symbols: bytes, steps: list[tuple[int, ...]], at: int) -> tuple[str, int]:
        """The edits from entry ``at``, and the entry where they end."""
        edits = []
        for s, to in zip(symbols, steps, strict=True):
            edits.append(ARCS[s][at][to[at]][1])
            at = to[at]
        return "".join(edits), at

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Cost and audit of a whole conversation."""
        path, total = self.scan(symbols, self.begin[START])
        ends = [v + t[0] for v, t in zip(self.vectors[path[-1]], TAIL, strict=True)]
        best = min(ends)
        steps = self.trace(symbols, path, sum(1 << q for q in STATES if ends[q] == best))
        edits, end = self.read(symbols, steps, START)
        return total + best, edits + TAIL[end][1]

    def between(self, symbols: bytes) -> list[tuple[int, str] | None]:
        """(cost, least edits) from each state to each, 16 in all; none where another way is always better."""
        out: list[tuple[int, str] | None] = []
        for a in STATES:
            path, total = self.scan(symbols, self.begin[a])
            for b, v in enumerate(self.vectors[path[-1]]):
                out.append((total + v, self.read(symbols, self.trace(symbols, path, 1 << b), a)[0]) if v < FAR else None)
        return out


def joined(tables: list[list[tuple[int, str] | None]]) -> tuple[int, list[str]]:
    """Cost of a conversation and the edits of each of its stretches, given as tables of ``between``."""
    later: list[int] = [t[0] for t in TAIL]
    turns: list[list[int]] = []
    for table in reversed(tables):
        now, to = [FAR] * 4, [-1] * 4
        for a in STATES:
            ways = [(w[0] + later[b], w[1], b) for b in STATES if (w := table[4 * a + b]) and later[b] < FAR]
            if ways:
                now[a], _, to[a] = min(ways)
        later, turns = now, [to, *turns]
    at, edits = START, []
    for table, to in zip(tables, turns, strict=True):
        edits.append(table[4 * at + to[at]][1])
        at = to[at]
    edits[-1] += TAIL[at][1]
    return later[START], edits


# ---------------------------------------------------------------- rows in order, with their faults
def key_of(conv_id: Column) -> Column:
    """The conversation as text; no id is written like the null one's space."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def ordered(rows: DataFrame, parts: int) -> DataFrame:
    """k, turn, role, text, sha and pos, which rises in the order of each conversation; pos >> 33 is the part."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    own = rows.select(key_of(F.col("conv_id")).alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("salt"))
    by = [F.col("k"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("sha"), F.col("salt")]  # the salt deals identical rows
    return C.materialize(own.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("salt").withColumn("pos", F.monotonically_increasing_id()), "turns")


def faulty(turns: DataFrame) -> DataFrame:
    """k, turn, pos, role class and fault of each row; texts are not moved."""
    core = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    classes = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    own = turns.select("k", "turn", "pos", "role", "sha", classes.alias("class"), (core == "").alias("blank"), (~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("open"))
    first = own.groupBy("k", "role", "sha").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(NONE)
    return own.join(first, "pos", "left").select("k", "turn", "pos", F.col("class").cast("int").alias("class"), fault.cast("int").alias("fault"))


# ---------------------------------------------------------------- scans
_RUN = "k string, part long, pos long, blank long, duplicate long, truncated long, illegal long, least long, greatest long, turns long, class_first int, class_last int, turn_first long, turn_last long, cost long, audit string, costs array<long>, edits array<string>"
_LEGAL = np.zeros(16, bool)
_LEGAL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True


def runs(rows: DataFrame) -> DataFrame:
    """One row a conversation and part: counts, and the audit, or the table between states where the part's edge is met."""
    names = [c.split()[0] for c in _RUN.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _RUN.split(", ")])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n, auto = len(table), Automaton()
        k = table["k"].to_numpy()
        turn, known = table["turn"].fill_null(0).to_numpy(), table["turn"].is_valid().to_numpy()
        kind, fault, pos = table["class"].to_numpy(), table["fault"].to_numpy(), table["pos"].to_numpy()
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        ends = np.append(starts[1:], n)
        inner = np.ones(n, bool)
        inner[starts] = False
        illegal = np.append(False, ~_LEGAL[kind[:-1] * 4 + kind[1:]]) & inner
        fresh = known & ~(inner & np.append(False, known[:-1] & (turn[1:] == turn[:-1])))
        count = lambda x: np.add.reduceat(x.astype(np.int64), starts).tolist()
        gone = (fault == BLANK) | (fault == DUPLICATE)
        symbols = np.where(gone, 0, 1 + 2 * kind + (fault == TRUNCATED)).astype(np.uint8).tobytes()
        counts = list(zip(count(fault == BLANK), count(fault == DUPLICATE), count(fault == TRUNCATED), count(illegal), strict=True))
        turns = count(fresh)
        rows = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            own = turn[a:b][known[a:b]]
            span = (int(own[0]), int(own[-1])) if len(own) else (None, None)
            cost = audit = costs = edits = None
            if a == 0 or b == n:
                ways = auto.between(symbols[a:b])
                costs, edits = [w[0] if w else None for w in ways], [w[1] if w else None for w in ways]
            else:
                cost, audit = auto.solve(symbols[a:b])
            edge = [int(turn[x]) if known[x] else None for x in (a, b - 1)]
            rows.append((k[a], int(pos[a]) >> 33, int(pos[a]), *counts[i], *span, turns[i], int(kind[a]), int(kind[b - 1]), *edge, cost, audit, costs, edits))
        return pa.Table.from_arrays([pa.array(c, schema.field(x).type) for x, c in zip(names, zip(*rows, strict=True), strict=True)], schema=schema)

    return rows.withColumn("part", F.shiftright("pos", 33)).groupBy("part").applyInArrow(lambda t: scan(t), _RUN)


def settled(found: DataFrame) -> DataFrame:
    """The runs with cost (at a conversation's first run) and audit of each; tables of one conversation meet here."""
    done = found.where(F.col("audit").isNotNull()).select("k", "pos", "cost", "audit")

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pairs = zip(table["costs"].to_pylist(), table["edits"].to_pylist(), strict=True)
        cost, edits = joined([[(c, e) if e is not None else None for c, e in zip(*p, strict=True)] for p in pairs])
        return pa.table({"k": table["k"], "pos": table["pos"], "cost": pa.array([cost] + [0] * (len(table) - 1), pa.int64()), "audit": pa.array(edits, pa.string())})

    met = found.where(F.col("audit").isNull()).select("k", "pos", "costs", "edits").groupBy("k").applyInArrow(lambda t: meet(t), "k string, pos long, cost long, audit string")
    return done.unionByName(met)


def reports(found: DataFrame, audits: DataFrame) -> DataFrame:
    """k, gaps, the faults, illegal, cost, audit; a conversation has a row a part at most in these tables."""
    by = W.partitionBy("k").orderBy("pos")
    before, last = F.lag("class_last").over(by), F.lag("turn_last").over(by)
    pair = before * 4 + F.col("class_first")
    seam = F.when(before.isNotNull() & ~pair.isin(1, 6, 9), 1).otherwise(0)  # su, ua, au
    again = F.when(last == F.col("turn_first"), 1).otherwise(0)
    own = found.withColumn("seam", seam).withColumn("again", again)
    total = lambda c: F.sum(c).alias(c)
    gaps = F.coalesce(F.max("greatest") - F.min("least") + 1 - F.sum(F.col("turns") - F.col("again")), F.lit(0))
    counts = own.groupBy("k").agg(gaps.alias("gaps"), *map(total, FAULTS), F.sum(F.col("illegal") + F.col("seam")).alias("illegal"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "audit"))), lambda x: x["audit"]), "")
    return counts.join(audits.groupBy("k").agg(F.sum("cost").alias("cost"), text.alias("audit")), "k")


# ---------------------------------------------------------------- repaired turns
_EDITED = "k string, edit string, role string, text string"


def edited(turns: DataFrame, audits: DataFrame, parts: int) -> DataFrame:
    """Every edit in order, as a stream by conversation: k, edit, and the role and text that remain (null of deleted rows)."""
    rows = turns.select("k", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "role", "text")
    letters = audits.select("k", "pos", F.lit(0).alias("kind"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = rows.unionByName(letters).repartition(parts, "k").sortWithinPartitions("k", "pos", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, turn = None, "", 0, 0
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, turn
            while at < len(audit) and audit[at] == "I":
                out.append((key, "I", ("user", "assistant")[turn], ""))
                at, turn = at + 1, 1 - turn

        for batch in batches:
            for k, kind, letters, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "kind", "audit", "role", "text")), strict=True):
                if k != key or kind == 0:
                    insert()
                if k != key:
                    key, turn = k, 0
                if kind == 0:
                    audit, at = letters, 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit == "D":
                    out.append((key, "D", None, None))
                    continue
                out.append((key, edit, ("user", "assistant")[turn] if edit == "R" else role, text))
                if edit == "R" or role[:1] != "s":
                    turn = 1 - turn
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["k", "edit", "role", "text"])
            out.clear()
        insert()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["k", "edit", "role", "text"])

    return stream.mapInArrow(run, _EDITED)


def digests(edits: DataFrame) -> DataFrame:
    """k and the SHA-256 of the remaining ``role:text``, joined by line feeds; edits of a conversation come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, empty = None, hashlib.sha256(), True
        for batch in batches:
            done = []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "role", "text")), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state, empty = k, hashlib.sha256(), True
                if role is not None:
                    state.update((("" if empty else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*done, strict=True) if done else [[]] * 2)], names=["k", "repaired_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["k", "repaired_sha256"])

    return edits.select("k", "role", "text").mapInArrow(run, "k string, repaired_sha256 string")


def repair(conversations: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports by k, every edit in order with the role and text that remain) of conv_id, turn, role, text."""
    parts = parts or C.parts_for(conversations, PART_MB)
    turns = ordered(conversations, parts)
    found = C.materialize(runs(faulty(turns)), "runs")
    audits = C.materialize(settled(found), "audits")
    return reports(found, audits), edited(turns, audits, parts)


# ---------------------------------------------------------------- the query
def damaged(conversations: DataFrame) -> DataFrame:
    """One row in four spoilt, by crc32 of ``conv_id:turn``: dropped, emptied, without its sentence marks, repeated, renamed."""
    space = F.lit(" ")
    turn = F.coalesce(F.col("turn").cast("string"), space)
    crc = F.pmod(F.crc32(F.concat(key_of(F.col("conv_id")), F.lit(":"), turn).cast("binary")), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    spoilt = F.when(crc == 1, "").when(crc == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(crc == 3, 2).otherwise(1).cast("int")))
    return conversations.where(crc != 0).select("conv_id", "turn", F.when(crc == 4, "user").otherwise(role).alias("role"), spoilt.alias("text"), copies.alias("copy")).drop("copy")


def audit(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """The contract's digest of the repaired damaged conversations, one row an original conv_id."""
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("k", key_of(F.col("conv_id")))
    report, edits = repair(damaged(conversations), parts or C.parts_for(conversations, PART_MB))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        every.join(report, "k", "left")
        .join(digests(edits), "k", "left")
        .select("conv_id", zero("gaps"), *map(zero, FAULTS), zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    )
