"""The registered queries of this subpackage; each reads whole tables below ``sf_dir``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varstrip.llm import (
    bpe, decontaminate, filter_audit, jaccard_join, license_scan, merkle, minmax_dedup, pii, quality_rules, secret_scan, substring_dedup,
    suffix_dedup, url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op2(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op3(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op4(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op5(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op6(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op7(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op9(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op10(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12(table(spark, sf_dir, "documents"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.op13(table(spark, sf_dir, "documents"))


_ALL = (
    op1_decontamination, op2_suffix_dedup, op3_secret_scan, op4_ngram_jaccard_join, op5_pii, op6_bpe, op7_url_filter,
    op8_quality_rules, op9_license_scan, op10_substring_dedup, op11_filter_audit, op12_merkle_manifest, op13_minmax_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op7_url_filter": url_filter.OP7_SQL, "op11_filter_audit": filter_audit.OP11_SQL}
