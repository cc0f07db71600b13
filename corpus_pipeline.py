"""The corpus pipeline: five stages, each a documents table in, a documents table out, the last a mixture.

A stage reads what its predecessor wrote. ``run`` writes each stage's result as Parquet in
the folder that the cluster shares and reads it again, so a lost executor costs one stage
at most.

Every stage takes an empty table, and tables with more columns than those of documents, which all but the last hand on.
Null texts count as empty ones; whole texts are read, however long; rows that repeat are rows like others: one of them
stays in the exact stage, which knows equal texts, and those after it see no repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cantata.llm import decontaminate, exact_dedup, mixing, quality_crf, simhash
from cantata.llm.common import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, empty ones by their score too; it learns from the labels of the documents that it sees (without labels all score one half, and go)."""
    return quality_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays, then the smallest doc_id."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: which documents are taken, and how often."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]

#: The classifier and XXH64 fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
