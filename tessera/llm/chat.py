"""Chat formatting: a hidden Markov model recovers who speaks in a raw transcript, and the turns are rendered canonically.

States are the first and the following lines of a system, user or assistant turn.  A line shows

* the speaker its marker names, if it has one, and whether that marker is of the transcript's own style: the style most
  of its markers have, the first of equals;
* whether the marker is written as it should be, whether a blank line stands before the line, whether it lies in a code
  fence or is indented, and whether a line next to it has the shape of a list (``word:``) without being a marker.

The model's tables are fixed values below.  Viterbi decoding of the lines gives the roles, so a turn without marker is
placed by the blank line and by who spoke before, and a marker inside a turn may be found to be text.  A marker is cut
off only where a turn begins; all other lines, blank ones and indentation too, stay as they are.

A conversation may come in several stretches.  It is decoded as one: a stretch first gives the best score from each
state before it to each state at its end, these tables are joined along the conversation (a few hundred bytes a stretch),
and then each stretch is decoded between its two known states.  So no task needs a whole long conversation, and the
path is as good as that of a single pass.

Null and empty transcripts have no turns and give no row.  Lines before the first marker belong to whatever role the
model finds.  Equal transcripts in equal stretches give equal rows; of equally good paths
one is taken by the order of states, which stretches may settle otherwise than a single pass.  Very long texts are lines
like others.  When transcripts are assembled from a table of turns, repeated rows count once, ties
of a turn number are ordered by text, null numbers come first, and ``STRETCH`` turn numbers make a stretch.  An empty
table gives an empty result.  Columns other than those named are not read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common as C

ROLES = ("system", "user", "assistant")
#: Speaker markers understood at the start of a line, by style, for system, user and assistant (fixed values).
STYLES = (("System:", "User:", "Assistant:"), ("<|system|>", "<|user|>", "<|assistant|>"), ("### System:", "### Instruction:", "### Response:"), ("[SYSTEM]", "[USER]", "[ASSISTANT]"), ("System:", "Human:", "AI:"), ("System:", "Q:", "A:"))
STRETCH = 512

_NAMED: dict[str, tuple[int, frozenset[int], str]] = {}  # marker in lower case -> role, styles, as it should be written
for _k, _style in enumerate(STYLES):
    for _r, _m in enumerate(_style):
        _NAMED[_m.lower()] = (_r, _NAMED.get(_m.lower(), (_r, frozenset(), _m))[1] | {_k}, _m)
_MARKER = re.compile(r"[ \t]*(" + "|".join(re.escape(m) for m in sorted(_NAMED, key=len, reverse=True)) + r")[ \t]?", re.IGNORECASE)
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_LISTED = re.compile(r"[ \t]*[\w-]{1,16}:")
_INDENT = re.compile(r"\t| {4}")

#: Kinds of marker: of the transcript's style by role, none, of another style by role.
OWN, NONE, FOREIGN = 0, 3, 4


def _tables() -> tuple[np.ndarray, ...]:
    """Log start (6), transition (6, 6), and emissions: marker (6, 7), case (6, 2), blank (6, 2 marked, 2), inside (6, 2), list (6, 2 marked, 2).

    State 2r begins and 2r + 1 continues role r.
    """
    start = [0.2, 1e-4, 0.75, 1e-4, 0.05, 1e-4]
    follows = {0: (0.01, 0.97, 0.02), 1: (0.01, 0.03, 0.96), 2: (0.01, 0.96, 0.03)}  # who speaks after whom
    stay = 0.6
    trans = np.full((6, 6), 1e-9)
    marker, case, blank, inside, listed = (np.zeros((6, *shape)) for shape in ((7,), (2,), (2, 2), (2,), (2, 2)))
    for r in range(3):
        begin, go_on = 2 * r, 2 * r + 1
        for s in (begin, go_on):
            trans[s, go_on] = stay
            for q in range(3):
                trans[s, 2 * q] = (1 - stay) * follows[r][q]
        marker[begin] = [0.8 if q == r else 0.006 for q in range(3)] + [0.16] + [0.024 if q == r else 0.002 for q in range(3)]
        marker[go_on] = [0.0007] * 3 + [0.992] + [0.002] * 3
        case[begin], case[go_on] = (0.95, 0.05), (0.6, 0.4)
        blank[begin] = [[0.08, 0.92], [0.5, 0.5]]
        blank[go_on] = [[0.93, 0.07], [0.93, 0.07]]
        inside[begin], inside[go_on] = (0.999, 0.001), (0.8, 0.2)
        listed[begin] = [[0.9, 0.1], [0.98, 0.02]]
        listed[go_on] = [[0.9, 0.1], [0.3, 0.7]]
    return tuple(np.log(x) for x in (start, trans, marker, case, blank, inside, listed))


_START, _TRANS, _MARK, _CASE, _BLANK, _INSIDE, _LIST = _tables()


# ---------------------------------------------------------------- lines
@dataclass
class Lines:
    """The lines of a stretch that are not blank, the blank lines before each, and their markers (match or None)."""

    text: list[str]
    gaps: list[list[str]]
    marks: list[re.Match | None]
    fences: list[bool]

    @classmethod
    def of(cls, text: str) -> Lines:
        own, held = cls([], [], [], []), []
        for line in text.split("\n"):
            if line.strip():
                own.text.append(line)
                own.gaps.append(held)
                own.marks.append(_MARKER.match(line))
                own.fences.append(_FENCE.match(line) is not None)
                held = []
            else:
                held.append(line)
        return own

    def styles(self) -> list[int]:
        """How many markers fit each style."""
        return [sum(m is not None and k in _NAMED[m[1].lower()][1] for m in self.marks) for k in range(len(STYLES))]

    def first_style(self) -> int:
        return next((min(_NAMED[m[1].lower()][1]) for m in self.marks if m is not None), -1)

    def emissions(self, style: int, fenced: bool, fences_count: bool, first: bool) -> np.ndarray:
        """(lines, 6) log-probabilities.  fenced: the stretch begins inside a fence; first: nothing stands before it."""
        out = np.zeros((len(self.text), 6))
        shaped = [_LISTED.match(x) is not None for x in self.text]
        for i, (line, mark) in enumerate(zip(self.text, self.marks, strict=True)):
            role, styles, written = _NAMED[mark[1].lower()] if mark else (0, frozenset(), "")
            kind = NONE if not mark else OWN + role if style in styles else FOREIGN + role
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(shaped) and shaped[j] and self.marks[j] is None and not self.gaps[max(i, j)]]
            marked = int(mark is not None)
            fenced ^= fences_count and self.fences[i]
            within = (fenced or fences_count and self.fences[i]) or (_INDENT.match(line) is not None)
            out[i] = _MARK[:, kind] + _BLANK[:, marked, int(bool(self.gaps[i]) or i == 0 and not first)] + _INSIDE[:, int(within)] + _LIST[:, marked, int(bool(near))]
            if mark:
                out[i] += _CASE[:, int(mark[1] != written)]
        return out

    def turns(self, path: list[int], opens: bool = True) -> list[tuple[bool, str, str]]:
        """(begins here, role, text) of every turn or part of one, in order; opens: nothing stands before."""
        out: list[tuple[bool, int, list[str]]] = []
        for i, s in enumerate(path):
            line, begins = self.text[i], s % 2 == 0 or opens and i == 0
            if begins or not out:
                cut = self.marks[i] if s % 2 == 0 else None
                out.append((begins, s // 2, [line[cut.end() :] if cut else line] if begins else [*self.gaps[i], line]))
            else:  # blank lines before a line that goes on belong to the text
                out[-1][2].extend([*self.gaps[i], line])
        return [(b, ROLES[r], "\n".join(x[1:] if b and len(x) > 1 and not x[0].strip() else x)) for b, r, x in out]


# ---------------------------------------------------------------- decoding
def forward(emissions: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best scores of the states at the ends, from each start, and the backward pointers; all stretches step together.

    start: (stretches, starts, 6), the scores of the first line's states before its emission.
    """
    order = np.argsort([-len(e) for e in emissions], kind="stable")
    sizes = np.array([len(emissions[k]) for k in order])
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([emissions[k] for k in order])
    score = start[order] + flat[at[:-1]][:, None, :]
    back = np.zeros((len(flat), start.shape[1], 6), np.int8)
    for t in range(1, int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, "left"))  # stretches with more than t lines
        step = score[:n, :, :, None] + _TRANS
        back[at[:n] + t] = step.argmax(2)
        score[:n] = step.max(2) + flat[at[:n] + t][:, None, :]
    out, pointers = np.empty_like(score), [back[:0]] * len(order)
    out[order] = score
    for place, k in enumerate(order):
        pointers[k] = back[at[place] : at[place + 1]]
    return out, pointers


def backward(pointers: np.ndarray, last: int) -> list[int]:
    path = [last]
    for step in pointers[:0:-1]:
        path.append(int(step[path[-1]]))
    return path[::-1]


def parse(text: str | None) -> list[tuple[str, str]]:
    """(role, text) of every turn of a transcript that is one stretch."""
    lines = Lines.of(text or "")
    if not lines.text:
        return []
    style, paired = main_style([lines.styles()], [lines.first_style()]), sum(lines.fences) % 2 == 0
    score, pointers = forward([lines.emissions(style, False, paired, True)], _START[None, None])
    return [(r, t) for _, r, t in lines.turns(backward(pointers[0][:, 0], int(score[0, 0].argmax())))]


def main_style(counts: list[list[int]], firsts: list[int]) -> int:
    total = np.sum(counts, 0)
    first = next((f for f in firsts if f >= 0), -1)
    return first if first >= 0 and total[first] == total.max() else int(total.argmax()) if total.max() else -1


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


# ---------------------------------------------------------------- over stretches
def _by_piece(rows, schema: str, columns: list[str]):
    """mapInArrow over slices of stretches; rows: (stretches as dicts) -> rows of the schema."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = rows(batch.slice(lo, 256).to_pylist())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return lambda df: df.select(*columns).mapInArrow(run, schema)


def summaries(pieces: list[dict]) -> list[tuple]:
    out = []
    for p in pieces:
        lines = Lines.of(p["transcript"] or "")
        if lines.text:
            out.append((p["conv"], p["stretch"], sum(lines.fences), np.array(lines.styles(), np.int64).tobytes(), lines.first_style()))
    return out


def settings(table: pa.Table) -> pa.Table:
    """Style and fence state of each stretch of a conversation (conv, stretch, style, fenced, paired, first)."""
    table = table.sort_by("stretch")
    fences = table.column("fences").to_numpy()
    style = main_style([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("styles")], table.column("first").to_pylist())
    before = np.concatenate([[0], np.cumsum(fences)[:-1]])
    n, paired = table.num_rows, bool(fences.sum() % 2 == 0)
    return pa.table({"conv": table.column("conv"), "stretch": table.column("stretch"), "style": pa.array([style] * n, pa.int32()), "fenced": before % 2 == 1 if paired else np.zeros(n, bool), "paired": [paired] * n, "head": np.arange(n) == 0})


def _emissions(p: dict) -> tuple[Lines, np.ndarray]:
    lines = Lines.of(p["transcript"])
    return lines, lines.emissions(p["style"], p["fenced"], p["paired"], p["head"])


def transfers(pieces: list[dict]) -> list[tuple]:
    """Best scores (7, 6) through each stretch: from each state of the line before it, and from the start."""
    start = np.concatenate([_TRANS, _START[None]])[None].repeat(len(pieces), 0)
    score, _ = forward([_emissions(p)[1] for p in pieces], start)
    return [(p["conv"], p["stretch"], s.tobytes()) for p, s in zip(pieces, score, strict=True)]


def borders(table: pa.Table) -> pa.Table:
    """States before and at the end of each stretch on the best path of the conversation."""
    table = table.sort_by("stretch")
    steps = [np.frombuffer(b.as_buffer(), np.float64).reshape(7, 6) for b in table.column("scores")]
    score, back = steps[0][6], []
    for m in steps[1:]:
        step = score[:, None] + m[:6]
        back.append(step.argmax(0))
        score = step.max(0)
    ends = [int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends = ends[::-1]
    return pa.table({"conv": table.column("conv"), "stretch": table.column("stretch"), "before": pa.array([-1, *ends[:-1]], pa.int32()), "last": pa.array(ends, pa.int32())})


def decoded(pieces: list[dict]) -> list[tuple]:
    own = [_emissions(p) for p in pieces]
    start = np.stack([_START if p["before"] < 0 else _TRANS[p["before"]] for p in pieces])[:, None]
    _, pointers = forward([e for _, e in own], start)
    out = []
    for p, (lines, _), back in zip(pieces, own, pointers, strict=True):
        n = 0
        for i, (begins, role, text) in enumerate(lines.turns(backward(back[:, 0], p["last"]), p["before"] < 0)):
            n += begins
            out.append((p["conv"], p["stretch"], i, n, begins, role, text))
    return out


def format_transcripts(transcripts: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered of every turn of transcripts (conv_id, stretch, transcript).

    Stretches of one conversation are parts of one transcript with a blank line between them; rows equal in conv_id and
    stretch count once (the least text).  Conversations without an id are one conversation.
    """
    key = ["conv", "stretch"]
    conv, stretch = F.col("conv_id").cast("long"), F.coalesce(F.col("stretch").cast("long"), F.lit(0))
    rows = transcripts.select(F.coalesce(conv, F.lit(0)).alias("id"), conv.isNull().alias("none"), stretch.alias("stretch"), F.col("transcript").cast("string").alias("transcript"))
    rows = rows.groupBy(F.concat(F.when(F.col("none"), "none").otherwise(""), F.col("id").cast("string")).alias("conv"), "stretch").agg(F.min("transcript").alias("transcript"))
    pieces = C.materialize(rows.where("transcript is not null"), "transcripts")
    said = _by_piece(summaries, "conv string, stretch long, fences long, styles binary, first int", [*key, "transcript"])(pieces)
    known = said.groupBy("conv").applyInArrow(settings, "conv string, stretch long, style int, fenced boolean, paired boolean, head boolean")
    pieces = C.materialize(pieces.join(known, key), "transcripts_known")
    columns = [*key, "transcript", "style", "fenced", "paired", "head"]
    scores = _by_piece(transfers, "conv string, stretch long, scores binary", columns)(pieces)
    between = scores.groupBy("conv").applyInArrow(borders, "conv string, stretch long, before int, last int")
    parts = _by_piece(decoded, "conv string, stretch long, i long, n long, begins boolean, role string, text string", [*columns, "before", "last"])(pieces.join(between, key))
    parts = C.materialize(parts, "turns")
    before = W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    first = parts.groupBy(*key).agg(F.max("n").alias("begun")).select(*key, F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("earlier"))
    numbered = parts.join(first, key).select("conv", (F.col("earlier") + F.col("n") - 1).alias("turn"), "stretch", "i", "begins", "role", "text")
    # turns that go on in a later stretch are put together; all others stay where they are
    split = numbered.where("not begins").select("conv", "turn").distinct()
    whole = numbered.join(split, ["conv", "turn"], "left_anti").select("conv", "turn", "role", "text")
    in_order = F.sort_array(F.collect_list(F.struct("stretch", "i", "text")))  # one turn's parts
    joined = numbered.join(split, ["conv", "turn"], "left_semi").groupBy("conv", "turn").agg(F.min_by("role", F.struct("stretch", "i")).alias("role"), F.array_join(F.transform(in_order, lambda x: x["text"]), "\n\n").alias("text"))
    out = whole.unionByName(joined)
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    return out.select(F.when(~F.startswith("conv", F.lit("none")), F.col("conv").cast("long")).alias("conv_id"), "turn", "role", "text", rendered.alias("rendered"))


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """Transcripts as they are found in the wild: each conversation in one of STYLES, about one turn in five without marker.

    What the turn's text itself holds is kept, blank lines too, though they also separate turns here.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marks = F.array(*[F.array(*[F.lit(m) for m in s]) for s in STYLES])
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    known = F.coalesce(role, F.lit(0)) > 0
    bare = (F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(5)) == 0) | ~known
    marker = F.when(bare, F.lit("")).otherwise(F.concat(F.get(F.get(marks, style.cast("int")), (F.coalesce(role, F.lit(1)) - 1).cast("int")), F.lit(" ")))
    lines = t.select("conv_id", F.floor(F.coalesce("turn", F.lit(0)) / STRETCH).alias("stretch"), F.struct("turn", F.concat(marker, F.col("text")).alias("line")).alias("x"))
    grouped = lines.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return grouped.select("conv_id", "stretch", F.array_join(F.transform("xs", lambda x: x["line"]), "\n\n").alias("transcript"))


def format_conversations(turns: DataFrame) -> DataFrame:
    return format_transcripts(raw_transcripts(turns))
