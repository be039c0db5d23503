"""One query per training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, decontaminate, extendible_dedup, kdtree_shards, line_join, lsh_forest, mixing, token_edits, toxicity, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_groups(table(spark, sf_dir, "documents"), k=4)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_edits.count_report(table(spark, sf_dir, "documents"))


def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_shards.shard_report(table(spark, sf_dir, "documents"), shards=40)


def op10_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_dedup.exact_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixing, op2_quality, op3_lsh_forest, op4_toxicity, op5_warc, op6_token_edits, op7_line_join, op8_decontamination, op9_kdtree_shards, op10_extendible_dedup)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.REPORT_SQL, "op5_warc": warc.REPORT_SQL, "op10_extendible_dedup": extendible_dedup.REPORT_SQL}
