"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

The stages are those of ``tessera.llm.pipeline``, which states what they do with awkward input; they are looked up when
they run.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _stage(name: str):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        from tessera.llm import pipeline

        return dict(pipeline.STAGES)[name](spark, docs, sf_dir)

    return stage


STAGES = [(name, _stage(name)) for name in ("quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing")]

#: Votes, sketches, seeds and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pipeline

    return pipeline.run(spark, sf_dir)
