"""A training corpus from raw documents: quality rules, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontamination, near_copies as copies, packing, quality_rules, substring_fm
from strandline.llm.rows import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules; cut boilerplate lines out of the others."""
    return quality_rules.apply_line_rules(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: candidates by SimHash and MinHash, verified by a five-word Jaccard of 0.8 at least."""
    return copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of 50 words or more that an earlier document has."""
    return substring_fm.cut_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("near-dedup", near_copies), ("substring dedup", repeated_passages),
          ("decontamination", benchmark_leaks), ("packing", sequences)]
# Edit distance, tokens and the packing program have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
