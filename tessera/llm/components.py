"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is written to the shared folder; a node with many links is met only in sums that combine before the shuffle
and in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the least node of its component."""
    edges = C.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = C.materialize(small.select("u", "v"), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
