"""The corpus pipeline: documents pass through the training-data operators stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haggle.llm import bpe, mixing, near_dup, quality
from haggle.llm.common import ready_checkpoints
from haggle.llm.queries import SOURCE_WEIGHTS
from haggle.session import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return near_dup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the documents into the order in which sources mix to their target weights."""
    return mixing.mix(docs, SOURCE_WEIGHTS, keep=True)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts in their mixed order, which ``position`` tells; the ids decode back to them."""
    return bpe.bpe_corpus(mixing.in_order(docs))


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet into the shared folder and read again.

    What is written is deleted when the application ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ready_checkpoints(spark)
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
