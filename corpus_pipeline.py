"""A corpus pipeline over the table documents: language ID, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, jaccard, langid, packing, pii, substring
from loam.llm.common import spill


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised. The model learns from these documents' own labels."""
    return langid.keep_known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group linked by a Jaccard similarity of 0.8 or more, one row also where an id repeats; rows without an id or words stay."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that an earlier document has too."""
    return substring.remove(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into windows of 2048 tokens."""
    return packing.pack(docs, bpe.vocabulary())


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("substring_dedup", repeated_passages), ("pii", personal_data), ("packing", packed)]

#: Language models, hashing of code points and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
