"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, gaussian, lines, matroska, mixing, pitmanyor, sharding, simhash, suffixes, toxicity
from .common import table


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("n_passages", F.size("passages")).drop("passages")


def op4_benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(table(spark, sf_dir, "documents"))


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaussian.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ","))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_virtual_slots, op2_pitman_yor, op3_toxic_segments, op4_benchmark_alignment, op5_matroska_packets, op6_quadratic_quality, op7_line_join, op8_soft_mixing, op9_suffix_repeats, op10_simhash_blocks)}

ORACLES: dict[str, str] = {
    "op7_line_join": "SELECT doc_id, n_lines, n_removed, array_to_string(removed, ',') AS removed FROM (" + lines.ORACLE + ")",
}
