"""The corpus operators as registered queries, each over the whole of its table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cuckoo, html_extract, line_dedup, mixing, packing, quality_rules, secrets, simhash, toxicity, weak_labels


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_docs(spark, sf_dir))


def op2_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(_docs(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classified(_docs(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped_lines(_docs(spark, sf_dir))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_docs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_cuckoo_dedup, op3_quality_classifier, op4_line_dedup, op5_simhash_dedup,
        op6_toxicity, op7_secret_scan, op8_packing, op9_html_extraction, op10_mixing,
    )
}
SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_cuckoo_dedup": cuckoo.SQL,
    "op4_line_dedup": line_dedup.SQL,
}
