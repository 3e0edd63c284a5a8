"""Training-data pipeline: each stage reads what its predecessor kept and calls one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import decontaminate, minhash, pieces, quality, runtime, suffixes

#: Least similarity, in percent, of near copies.
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.classify(docs, runtime.read(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id, a null one before all others."""
    # rows without an id get ids below all others, each its own, so that a group keeps one of them
    nameless = runtime.materialise(docs.where("doc_id IS NULL").withColumn("key", F.monotonically_increasing_id()), "nameless")
    least = docs.agg(F.min("doc_id")).first()[0] or 0
    keyed = docs.where("doc_id IS NOT NULL").withColumn("key", F.col("doc_id")).unionByName(nameless.withColumn("key", F.lit(least) - 1 - F.col("key")))
    kept = minhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(kept, "key", "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 100 bytes and more are cut out; a character that a cut halves goes as a whole."""
    found = suffixes.repeats(docs, keep=("lang", "source"), text=True)
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold words of the benchmark go."""
    found = decontaminate.contamination(docs, runtime.read(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return found.where("n_hit = 0").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each remaining document."""
    return pieces.encode(docs).select("doc_id", "ids", "n_tokens", "n_unknown", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Learned scores, components and tokenizer ids have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written as Parquet and read again as the next one's documents."""
    docs = runtime.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = runtime.materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
