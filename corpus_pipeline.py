"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakegauge.llm import decontamination, language_id, line_dedup, near_dedup, packing
from lakegauge.llm.staging import staged
from lakegauge.session import prepare


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned, with that language as ``lang``; others, and those without letters, go."""
    prepare(spark)
    return language_id.recognised(docs, language_id.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go, and documents that have nothing else."""
    prepare(spark)
    return line_dedup.without_repeated_lines(docs, min_chars=20)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return near_dedup.one_of_each(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    prepare(spark)
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences they are packed into."""
    prepare(spark)
    return packing.pack(docs, capacity=2048)


STAGES = [("language", languages), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("sequences", sequences)]

#: Cross parsing, MinHash and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again as the next one's docs."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
