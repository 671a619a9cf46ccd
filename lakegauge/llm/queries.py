"""Registered queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.llm import (
    alignment, decontamination, fingerprint, language_id, license_scan, line_dedup, mixing, near_dedup, negatives, oracle, packing, quality, sharding, substring_dedup,
)
from lakegauge.session import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), threshold=0.85)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=2048)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(_table(spark, sf_dir, "documents"), min_chars=20, exact_chars=1)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_counted", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13, keep_text=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=24)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontamination.contaminated_windows(docs, items, width=5, threshold=0.8).drop("doc_key")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.repetitions(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0, seed=11)
    return found.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.align(docs, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", scale=256)
    return negatives.hard_negatives(rows, rows.filter("id % 50 = 0"), positives=5, negatives=3, low=50, high=95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_best_fit_packing, op3_line_dedup, op4_substring_dedup, op5_language_id, op6_sharding,
        op7_document_fingerprints, op8_quality_classifier, op9_minhash_near_dedup, op10_benchmark_decontamination,
        op11_source_mixing, op12_cross_tokenizer_alignment, op13_hard_negatives,
    )
}
#: The other queries have no SQL form (greedy choice, packing, learned models, crc32 and sketches); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": oracle.LINE_DEDUP,
    "op4_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op9_minhash_near_dedup": oracle.NEAR_DEDUP,
    "op10_benchmark_decontamination": oracle.DECONTAMINATION,
    "op11_source_mixing": oracle.MIXING,
    "op13_hard_negatives": oracle.NEGATIVES,
}
