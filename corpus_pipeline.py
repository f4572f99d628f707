"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns
the rows that go on, with the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscan.llm import jaccard, language, mixing, packing, quality
from fleetscan.llm.common import small_batches, stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or with no language that has a fair share of them, go."""
    small_batches(spark)
    return language.filtered(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts below the quality threshold go."""
    small_batches(spark)
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the smallest doc_id stays."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    small_batches(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("duplicates", duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express tokenizing, nor models that are fitted; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
