"""The corpus pipeline: quality filter, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import decontaminate, gaussian, mixing, sharding, simhash, wide
from treeline.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant accepts (posterior of good quality at least 0.3)."""
    return gaussian.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Groups are those of op10's operator (64-bit fingerprints, block keys, a Hamming check); then pairs of different groups whose
    five-word shingle sets are similar to 0.8 or more, but whose fingerprints lie further apart, are linked too.
    """
    groups = written(simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).select("doc_id", "component_id"), "simhash-groups")
    return wide.keep_one(docs, groups=groups)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its rate says."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def sharding_by_slots(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row with its shard and place."""
    return sharding.assign(docs, 16)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_targets),
    ("sharding", sharding_by_slots),
]

#: The classifier, fingerprints, alignment and rates are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's output written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs

