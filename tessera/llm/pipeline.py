"""The stages of the corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``, but for the last, which
returns the packed pieces.  Between stages the rows are written as Parquet and read again.

Null and empty texts fail the first stage; given to a later one they stay as they are (near-dedup keeps them all, packing
makes each a piece of one end token).  Very long texts are documents like others.  Ties: of equal documents the one with
the smallest doc_id stays, null ids last; repeated rows are documents of their own.  Empty tables give empty results in
all stages, and extra columns, whatever their names, travel through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontaminate, line_dedup, near_dedup, packing, quality_rules


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base checks and are probably good by the rules' weighted votes."""
    return quality_rules.quality_filter(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; rows of which no word is left go; n_chars follows the text."""
    return line_dedup.line_dedup(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id."""
    return near_dedup.near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window with the benchmark."""
    return decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
