"""A training-corpus pipeline: quality, near copies, benchmark passages, source weights, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlark.llm import decontam, mixing, neardup, quality, shards
from meshlark.llm.queries import good_labels
from meshlark.llm.spread import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects."""
    return quality.selected(docs, good_labels(spark, sf_dir))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.without_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mix_documents(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that holds them."""
    return shards.shard_documents(docs, scratch(spark, "shards"))[0]


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mixing", mixing_stage),
    ("sharding", shard_stage),
]

#: SQL can't express the classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
