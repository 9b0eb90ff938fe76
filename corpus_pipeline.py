"""A training corpus from raw documents: five stages, each writing what the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontaminate, mixing, quality, sharding, simhash
from turnloom.llm.common import discard, materialise, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), label="quality", folds=3, fold=1)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Shingles of five words, and 52 of 64 equal bits or more: a SimHash similarity of 0.8. Links of
    over six bits are verified: a Jaccard similarity of 0.8 or more between the shingle sets.
    """
    return simhash.drop_near_duplicates(docs, words=5, max_distance=12)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a row appears as often as its copies."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its place there."""
    return sharding.shard(docs.select("doc_id", "source", "text"), shards=24)


STAGES = [
    ("quality", quality_stage),
    ("simhash", dedup_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("shard", sharding_stage),
]

#: Learned weights and iterative solving are beyond SQL; tests plant cases for every stage, and the operators have their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the rows are written to the shared folder and read again.

    Once a stage's rows are written, what it and the stage before it left there goes.
    """
    docs, before = table(spark, sf_dir, "documents"), list(written)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, f"stage-{name}")
            discard(spark, [path for path in written[:-1] if path not in before])
    return docs
