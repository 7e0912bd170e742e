"""From raw documents to a token-ready training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it
returns is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``; the last adds what encoding
yields. Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import exact_dedup, mixing, near_join, quality, sentencepiece_fst
from scorelake.llm.common import shared_path, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quadratic discriminant takes for label 0 (operator 8)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (operator 10)."""
    return exact_dedup.keep_last_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word
    shingles, that with the smallest doc_id stays (operator 1)."""
    return near_join.keep_one_of_each(docs, k=5, num=8, den=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights, 150 % of the words, at most two epochs
    (operator 4): a row per repetition, whole or partial."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), budget=1.5, epochs=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (operator 6) and whether they give the text back,
    beside the columns of documents."""
    return sentencepiece_fst.encode(docs, same_col="same").withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_duplicates),
    ("n-gram jaccard join", near_duplicates),
    ("source mix", source_mix),
    ("sentencepiece", encode),
]

#: Stages 1, 3 and 5 (a fitted model, a similarity join, a tokenizer) have no SQL; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
