"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before kept, as written to Parquet. The first three drop rows, the fourth
shortens texts, and the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import language, quality, shingle_join, suffix_dedup, tier_packing
from pricelens.llm.tables import read, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and long texts in no known language."""
    return language.in_known_language(docs, language.learned(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score under a half. A model without labels scores every text a half, so all stay."""
    return quality.good(docs, quality.learned(docs, read(spark, sf_dir, "labels")))


def shingle_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return shingle_join.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the strings of 400 bytes and the runs of 50 words that occur elsewhere too out of every text;
    ``n_chars`` follows."""
    return suffix_dedup.without_repeats(docs, words=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of several lengths; the pieces carry their token ids."""
    return tier_packing.packed(docs, with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", shingle_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", packing),
]

#: Hashing, learning and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
