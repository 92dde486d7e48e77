"""The corpus pipeline: toxicity, quality, near duplicates, mixing, BPE. Part of the training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import bpe, mixing, quality, shingles, toxicity
from triagelake.llm.common import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at the threshold or above."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return shingles.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed corpus."""
    return bpe.encode_digest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near copies", one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first two stages decide by trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
