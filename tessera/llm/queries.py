"""The query of each operator, over its whole table with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    decontamination,
    language_id,
    line_dedup,
    near_duplicates,
    oracles,
    packing,
    quality_gam,
    quality_rules,
    sharding,
    token_files,
    toxicity,
)
from tessera.llm._shared import documents, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write(documents(spark, sf_dir)).documents()


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(documents(spark, sf_dir))


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_gam.predict(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(documents(spark, sf_dir)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_quality_rules,
        op3_token_files,
        op4_language_id,
        op5_packing,
        op6_near_duplicates,
        op7_quality_gam,
        op8_decontamination,
        op9_sharding,
        op10_line_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": oracles.QUALITY_RULES,
    "op9_sharding": oracles.SHARDING,
    "op10_line_dedup": oracles.LINE_DEDUP,
}
