"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (g), bad (b) or abstains (-).  A document's votes form a pattern; how often each pattern occurs
is all that the model needs, and there are at most 3^rules patterns whatever the input.  Expectation-maximisation over
these counts estimates each rule's accuracy in either class and the share of good documents; a document is kept if it
passes the base checks and its posterior probability of being good is at least ``min_posterior``.

Null and empty texts have no words, so they fail the base checks.  Equal rows get equal verdicts; ``doc_id`` is carried
along and may be null.  An empty table gives an empty result.  Input columns travel inside one struct, so extra columns
cannot clash with the computed ones.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A word of letters with at most one mark behind it.
PLAIN = "^\\p{L}+[.,;:!?]?$"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_POSTERIOR = 0.5

#: Rule name -> (bad when, good when); neither: the rule abstains.  They read the columns of base_columns().
RULES = {
    "symbols": ("n_symbols > 0.2 * n_words", "n_symbols <= 0.05 * n_words"),
    "word_length": ("word_chars > 9 * n_words or word_chars < 3 * n_words", "word_chars between 3.8 * n_words and 6.5 * n_words"),
    "line_copies": ("n_dup_lines > 0.35 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    "repeats": ("n_repeat_words > 0.35 * n_words", "n_repeat_words <= 0.15 * n_words"),
    "capitals": ("n_upper > 0.3 * word_chars", "n_upper <= 0.1 * word_chars"),
    "letters": ("word_chars - n_letters > 0.25 * word_chars", "word_chars - n_letters <= 0.12 * word_chars"),
    "plain_words": ("n_plain < 0.75 * n_words", "n_plain >= 0.85 * n_words"),
    "marks": ("n_marks > 0.3 * n_words", "n_marks <= 0.05 * n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_counts(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``row`` (the input's columns, or only those in ``also``) and the counts of each text.

    Word triples are compared by 64-bit hash within their own text.  Arrays stand in columns of their own so that no
    lambda evaluates them anew; the positions of repeats are sorted only for texts that have any.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (also or docs.columns)])
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(row.alias("row"), text.alias("t")).select(
        "row",
        "t",
        F.array_remove(F.split("t", SPACE), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
    )
    triple = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    none = F.array().cast("array<bigint>")
    step = step.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("words", lambda w: F.rlike(w, F.lit(PLAIN)))).cast("long").alias("n_plain"),
        count_of(F.col("t"), "!?").cast("long").alias("n_marks"),
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), triple)).otherwise(none).alias("h"),
    )
    kept = [c for c in step.columns if c != "h"]
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    step = step.select(*kept, F.when(repeated, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("sorted"))
    twin = lambda p, i, d: F.coalesce(F.get("sorted", i + d)["x"] == p["x"], F.lit(False))
    paired = F.filter("sorted", lambda p, i: F.when(i > 0, twin(p, i, -1)).otherwise(False) | twin(p, i, 1))
    step = step.select(*kept, F.sort_array(F.transform(paired, lambda p: p["i"])).alias("at"))
    fresh = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    covered = F.coalesce(F.aggregate(fresh, F.lit(0).cast("int"), lambda a, x: a + x), F.lit(0))
    return step.select(*kept, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def pattern() -> Column:
    return F.concat(*[F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for bad, good in RULES.values()])


def posteriors(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior probability of the good class by vote pattern; expectation-maximisation from this start on: no bad vote, good; one, open; more, bad."""
    if not counts:
        return {}
    total = sum(counts.values())
    post = {p: (0.95, 0.5, 0.05)[min(2, p.count("b"))] for p in counts}
    for _ in range(rounds):
        prior = min(max(sum(n * post[p] for p, n in counts.items()) / total, 1e-3), 1 - 1e-3)
        weight = {True: total * prior, False: total * (1 - prior)}
        table = {}
        for j in range(len(RULES)):
            for good in (True, False):
                for v in "gb-":
                    seen = sum(n * (post[p] if good else 1 - post[p]) for p, n in counts.items() if p[j] == v)
                    # a rule is presumed better than chance: one prior vote for its own side
                    table[j, good, v] = (seen + (1.0 if (v == "g") == good and v != "-" else 0.1)) / (weight[good] + 1.2)
        new = {}
        for p in counts:
            a = math.log(prior) + sum(math.log(table[j, True, v]) for j, v in enumerate(p))
            b = math.log(1 - prior) + sum(math.log(table[j, False, v]) for j, v in enumerate(p))
            new[p] = 1 / (1 + math.exp(min(700, max(-700, b - a))))
        moved = max(abs(new[p] - post[p]) for p in counts)
        post = new
        if moved < 1e-9:
            break
    return post


def judged(docs: DataFrame, also: tuple[str, ...] = (), min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``row``, the counts, base_failed, votes, posterior and kept, for every row of docs."""
    table = C.materialize(with_counts(docs, also).withColumn("base_failed", base_failed()).withColumn("votes", pattern()), "quality_counts")
    counts = {r["votes"]: r["n"] for r in table.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3^rules rows
    known = json.dumps([{"votes": p, "posterior": q} for p, q in posteriors(counts).items()])
    lookup = table.sparkSession.range(1).select(F.inline(F.from_json(F.lit(known), "array<struct<votes:string,posterior:double>>")))
    out = table.join(F.broadcast(lookup), "votes", "left")  # lookup: at most 3^rules rows
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))


def quality_filter(docs: DataFrame, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    return judged(docs, (), min_posterior).where("kept").select("row.*")
