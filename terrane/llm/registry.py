"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import (
    conversation_repair,
    decontamination,
    language_crf,
    licenses,
    line_dedup,
    minhash,
    mixing,
    periodic_runs,
    quality_bayes,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op3(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op4(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.op5(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op6(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op7(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.op11(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.op12(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_quality_rules": op3_quality_rules,
        "op4_minhash": op4_minhash,
        "op5_language_id": op5_language_id,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_mixing": op9_mixing,
        "op10_license_scan": op10_license_scan,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are held against
    brute force in the tests."""
    from terrane.llm import oracles

    return {
        "op3_quality_rules": oracles.quality_rules(),
        "op4_minhash": oracles.near_duplicates(),
        "op6_suffix_dedup": oracles.repeated_bytes(),
        "op7_substring_dedup": oracles.repeated_words(),
        "op9_mixing": oracles.mixing(),
        "op10_license_scan": oracles.licenses(),
        "op11_periodic_runs": oracles.periodic_runs(),
        "op12_conversation_repair": oracles.conversations(),
        "op13_line_dedup": oracles.repeated_lines(),
    }
