"""Text rules shared by the engine: lengths, white space, folding, terms, display strings.

Lengths and offsets are counted in UTF-16 units throughout.  Column functions run in the JVM; the plain functions of the
same names serve the Arrow functions and the driver.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The one white-space class of the engine.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
TERM = "[\\p{L}\\p{N}]+"
SUMMARY_CHARS = 140


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 64


def mapped(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of every row, slice by slice, so that a task never holds a batch's texts as Python strings."""
    done = []
    for lo in range(0, len(columns[0]), SLICE):
        done.append(pa.array([f(*row) for row in zip(*(c.slice(lo, SLICE).to_pylist() for c in columns), strict=True)], kind))
    return pa.concat_arrays(done) if done else pa.array([], kind)


# ---------------------------------------------------------------- UTF-16 units
def units(text: str) -> str:
    """The text with every UTF-16 unit a character of its own, so that len() and slices count units."""
    if not text or max(text) <= "\uffff":
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))


def joined(text: str) -> str:
    """units() undone; a lone surrogate becomes U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def tokens(n_units: int) -> int:
    return -(-n_units // 4)


def estimate_tokens(text: str) -> int:
    return tokens(len(units(text)))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up."""
    n = F.octet_length(F.encode(text, "UTF-16LE")) / 2
    return F.ceil(n / 4).cast("long")


# ---------------------------------------------------------------- folding
def fold_match(text: str) -> str:
    """Lower case without combining marks U+0300-U+036F: what terms and texts are matched in."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "\u0300" <= c <= "\u036f")


@functools.cache
def _diacritic() -> re.Pattern:
    import regex

    return regex.compile(r"\p{Diacritic}")


def fold_similar(text: str) -> str:
    """Lower case without any diacritic, spacing ones too: what paths and headings are compared in."""
    return _diacritic().sub("", unicodedata.normalize("NFD", text.lower()))


@functools.cache
def _fold_table(similar: bool) -> tuple[str, str]:
    """Characters of the basic plane that folding replaces by one other, then those it removes; a rule, not a list."""
    fold = fold_similar if similar else fold_match
    pairs, gone = [], []
    for c in map(chr, range(0x80 if not similar else 0x21, 0xFFFF)):
        if "\ud800" <= c <= "\udfff" or c != c.lower():
            continue
        to = fold(c)
        if to == "":
            gone.append(c)
        elif to != c and len(to) == 1:
            pairs.append((c, to))
    return "".join(a for a, _ in pairs) + "".join(gone), "".join(b for _, b in pairs)


def folded(text: Column, similar: bool = False) -> Column:
    """Folding in the JVM.  Hangul stays composed here, which changes no comparison: both sides are folded alike."""
    return F.translate(F.lower(text), *_fold_table(similar))


# ---------------------------------------------------------------- terms
def query_terms(text: Column) -> Column:
    """Runs of letters and digits, as written and with repeats."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


@functools.cache
def _term() -> re.Pattern:
    import regex

    return regex.compile(TERM)


def tokenize_query(text: str) -> list[str]:
    return _term().findall(text)


def index_terms(text: Column) -> Column:
    """Terms as the index holds them: of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0))


# ---------------------------------------------------------------- display
def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def present(text: Column) -> Column:
    """The trimmed text, or null where it is blank."""
    return F.nullif(trim(text), F.lit(""))


def condense(text: Column, most: int = SUMMARY_CHARS) -> Column:
    """White space runs become one blank; longer texts are cut and end in an ellipsis."""
    one = trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def display_summary(summary: Column, title: Column) -> Column:
    return condense(F.when(trim(summary) != "", summary).otherwise(title))


def humanized(path: Column) -> Column:
    """A title from a file name: no extension, dashes and underscores as blanks, a capital first."""
    base = F.regexp_replace(F.substring_index(path, "/", -1), "\\.md$", "")
    words = trim(F.regexp_replace(F.regexp_replace(base, "[-_]+", " "), f"[{SPACE}]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, sys.maxsize >> 33))


def module_of(path: Column, roots: tuple[str, ...] = ()) -> Column:
    """The first folder below the root the path lies in, or null for a file right there."""
    rest = path
    for r in reversed(roots):
        rest = F.when(path.startswith(f"{r}/"), F.substring(path, len(r) + 2, sys.maxsize >> 33)).otherwise(rest)
    return F.when(F.locate("/", rest) > 0, F.substring_index(rest, "/", 1))


def doc_line(type_: Column, path: Column, summary: Column, status: Column) -> Column:
    """``- [type] path — summary (status)``; what is absent is left out."""
    kind = F.coalesce(F.concat(F.lit("["), type_, F.lit("] ")), F.lit(""))
    state = F.coalesce(F.concat(F.lit(" ("), status, F.lit(")")), F.lit(""))
    return F.concat(F.lit("- "), kind, path, F.lit(" — "), summary, state)


def distance(target: Column, candidate: Column) -> Column:
    """Edits between the folded strings over the longer length; the candidate's length is taken as written."""
    a, b = folded(target, True), folded(candidate, True)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(candidate), F.lit(1))
