"""Line deduplication over line-ID sequences by distributed prefix doubling, in DataFrame functions only.

A document is the sequence of its \\n-separated lines that hold a word.  Ranks of runs of 1, 2, 4, ... lines up to
``min_lines`` are made by pairing the rank of a position with the rank one run further on; positions whose run is
unique drop out of every later round.  Two equal ranks at the last round mean a longest common prefix of at least
``min_lines`` lines, so the union of these runs is the union of all maximal repeated runs.  A line of ``long_words``
words or more is a run by itself.  The first copy - smallest doc_id, then place - stays and later copies are deleted,
also within one document.

``repeated_runs`` reports the maximal runs themselves, with their first copies.

Null and empty texts have no lines and come back as they are (null as empty).  Very long texts are rows of lines like
others.  Lines without a word never count and are
never deleted.  Rows equal in doc_id and text are one document and share its verdict (ties of ids: by a key
of the text); null ids come after all others.
An empty table gives an empty result.  Input columns travel inside one struct, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.quality_rules import SPACES

WORD = "[^\\x20\\x09-\\x0D]+"
MIN_LINES, LONG_WORDS = 2, 50


def line_table(docs: DataFrame, long_words: int) -> DataFrame:
    """doc and k (the document: id and key of its text), seq, pos, r1 and r2 (line ID of 128 bits) and whether the line is long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(
        F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("x"))), lambda s: F.length(F.translate(s["x"], SPACES, "")) > 0
    )
    rows = docs.select(document(F.col("doc_id")).alias("doc"), text.alias("t")).select("doc", F.xxhash64("t").alias("k"), worded.alias("lines"))
    line = rows.select("doc", "k", F.posexplode("lines").alias("seq", "line"))
    long = F.regexp_count("line.x", F.lit(WORD)) >= long_words
    return line.select("doc", "k", "seq", F.col("line.pos").alias("pos"), F.xxhash64("line.x").alias("r1"), F.xxhash64(F.lit(1), "line.x").alias("r2"), long.alias("long"))


def document(doc_id: Column) -> Column:
    """The id by which documents are ordered; null comes last."""
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def place() -> Column:
    return F.struct("doc", "k", "seq")


def reranked(at: DataFrame, name: str) -> DataFrame:
    """Drops positions of unique rank; adds ``first``, the earliest place of the rank, and ``copies``.

    The ranks' sums are written before positions are joined with them, so a rank that very many lines have is summed
    before the shuffle and split in the join.
    """
    groups = at.groupBy("r1", "r2").agg(F.min(place()).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return at.join(C.materialize(groups, f"{name}_groups"), ["r1", "r2"])


def doubled(at: DataFrame, ahead: DataFrame, step: Column | int) -> DataFrame:
    """Ranks of longer runs: the rank of a position and the rank ``step`` lines further on make one; ranks of ``ahead`` that have no partner leave."""
    onward = ahead.select("doc", "k", F.col("seq").alias("there"), F.col("r1").alias("n1"), F.col("r2").alias("n2"))
    paired = at.withColumn("there", F.col("seq") + step).join(onward, ["doc", "k", "there"])
    ranks = ("r1", "r2", "n1", "n2")
    return paired.select("doc", "k", "seq", F.xxhash64(*ranks).alias("r1"), F.xxhash64(F.lit(1), *ranks).alias("r2"))


def ranked_runs(lines: DataFrame, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """Positions whose line occurs again, and positions from which ``min_lines`` lines do; both with first and copies."""
    single = at = C.materialize(reranked(lines, "ranks_1"), "ranks_1")
    span = 1
    while span < min_lines:
        step = min(span, min_lines - span)
        span += step
        at = C.materialize(reranked(C.materialize(doubled(at, at, step), f"pairs_{span}"), f"ranks_{span}"), f"ranks_{span}")
    return single, at


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, k, pos) of every line to delete."""
    lines = C.materialize(line_table(docs, long_words).dropDuplicates(["doc", "k", "seq"]), "lines")
    later = place() != F.col("first")
    single, at = ranked_runs(lines, min_lines)
    cut = single.where(F.col("long") & later).select("doc", "k", "seq", F.lit(1).alias("run"))
    runs = cut.unionByName(at.where(later).select("doc", "k", "seq", F.lit(min_lines).alias("run")))
    seqs = runs.select("doc", "k", F.explode(F.sequence("seq", F.col("seq") + F.col("run") - 1)).alias("seq")).distinct()
    return seqs.join(lines, ["doc", "k", "seq"]).select("doc", "k", "pos")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Maximal repeated runs: doc_id, seq (first line among those with a word), run (lines), first_doc_id, first_seq.

    A position's longest common prefix with the first copy of its rank goes on as long as the next position's first copy
    is the next line of the same document; such an interval of positions is one run.
    """
    lines = C.materialize(line_table(docs, 1 << 30).dropDuplicates(["doc", "k", "seq"]), "lines")
    at = ranked_runs(lines, min_lines)[1].where(place() != F.col("first"))
    same = ["doc", "k", "first_doc", "first_k", "ahead"]
    at = at.select("doc", "k", "seq", F.col("first.doc").alias("first_doc"), F.col("first.k").alias("first_k"), (F.col("seq") - F.col("first.seq")).alias("ahead"))
    interval = at.withColumn("interval", F.col("seq") - F.row_number().over(W.partitionBy(*same).orderBy("seq"))).groupBy(*same, "interval")
    out = interval.agg(F.min("seq").alias("seq"), (F.count("*") + min_lines - 1).alias("run"))
    known = lambda c: F.when(F.col(c) < (1 << 63) - 1, F.col(c))
    return out.select(known("doc").alias("doc_id"), "seq", "run", known("first_doc").alias("first_doc_id"), (F.col("seq") - F.col("ahead")).alias("first_seq"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """``row`` (docs' columns), text without the deleted lines, n_lines and n_deleted."""
    gone = deleted_lines(docs, min_lines, long_words).groupBy("doc", "k").agg(F.collect_list("pos").alias("gone"))  # within one document
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"), document(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("k"))
    joined = rows.join(gone, ["doc", "k"], "left").select("row", "t", F.split("t", "\n").alias("lines"), "gone")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n = F.size(F.filter("lines", lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    return joined.select("row", kept.alias("text"), n.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_deleted"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with later copies of repeated runs deleted; documents of which no word is left go.  Columns stay docs' own; n_chars, where there, follows the text."""
    out = dedup_lines(docs, min_lines, long_words)
    emptied = (F.col("n_deleted") > 0) & (F.length(F.translate("text", SPACES, "")) == 0)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.where(~emptied).select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
