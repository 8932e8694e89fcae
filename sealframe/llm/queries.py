"""The corpus operators' queries, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sealframe.llm import decontaminate, licenses, packing, pii, quality, simhash, token_counts, token_files, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(_read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separator: the vocabulary's end of text, 50256."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "leading_space", 50256)


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_read(spark, sf_dir, "documents"))


def op5_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(_read(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(_read(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(_read(spark, sf_dir, "documents"))


def op9_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digests(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), capitals=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_skip_chain_pii": op4_skip_chain_pii,
    "op5_simhash_balls": op5_simhash_balls,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_token_files": op7_token_files,
    "op8_host_quality_rules": op8_host_quality_rules,
    "op9_url_template_tree": op9_url_template_tree,
    "op10_template_decontamination": op10_template_decontamination,
}

SQL: dict[str, str] = {"op2_license_scan": licenses.SQL, "op6_warc_revisits": warc.SQL, "op8_host_quality_rules": quality.SQL}
