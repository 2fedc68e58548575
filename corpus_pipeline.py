"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Reject what the quality classifier scores low, keep one of each group of equal texts, then one of each group of
near-duplicates, draw sources by target weights, and pack what is drawn into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from channelgraph.llm import exact, mixing, neardup, packing, quality
from channelgraph.llm.common import scratch_path, ship_package

# the stages cannot be told in SQL: boosted trees, sketches and a tokenizer are in them
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of rows that are not held out."""
    ship_package(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    ship_package(spark)
    return exact.exact_dedup(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    ship_package(spark)
    return neardup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """About as many documents as came, sources weighted by the square root of their size; a document may repeat."""
    ship_package(spark)
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    ship_package(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
