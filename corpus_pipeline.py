"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Language ID, exact dedup, near-duplicate removal and mixing return rows of documents; packing, the last
stage, returns where each kept row goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import exact_dedup, language_id, mixing, ngram_join, packing
from lithoframe.llm.common import documents, fold, staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is less likely than not."""
    return language_id.keep_identified(docs, fold("doc_id", 5) != 0, least=0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled inside shards."""
    mixed = mixing.mix(docs)
    where = mixed.columns[-2:]
    return mixed.repartitionByRange(*where).sortWithinPartitions(*where).drop(*where)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, padded length, batch and position of each row."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_lengths),
]
#: The similarity join, the mix and the packing can't be put in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
