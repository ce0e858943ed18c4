"""The corpus operators bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, language_id, license_scan, pii, quality_rules, secret_scan
from .dac import round_trip
from .jaccard_join import jaccard_join
from .packing import pack
from .token_counts import count_tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = quality_rules.quality(docs, rules)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = count_tokens(_docs(spark, sf_dir))
    return got.select("doc_id", F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "number", "start", "n_tokens")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.learn(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(_docs(spark, sf_dir))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = round_trip(_docs(spark, sf_dir))
    return got.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    got = pii.find(docs, pii.learn(docs))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return got.select("doc_id", *counts, F.sha2(pii.told("base"), 256).alias("base_sha256"), pii.told("spans").alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir)).drop("places")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secret_scan.scan(_docs(spark, sf_dir))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_QUERIES = [op1_quality_rules, op2_token_counts, op3_language_id, op4_harmonic_packing, op5_addressable_codes, op6_pii, op7_license_scan, op8_ngram_jaccard_join, op9_secret_scan, op10_benchmark_decontamination]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
