"""Cleaning of a corpus: quality, repeated lines, near duplicates, mixture, tokens.

Each stage takes what the one before has kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import lines, mixing, near_duplicates, pieces, quality
from stationlake.llm.common import table
from stationlake.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that five documents or more share, but for one of these."""
    return lines.without_common_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates.

    Rows without doc_id stay; rows that share a doc_id all stay if one of them does.
    """
    found = near_duplicates.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = found.where("not kept").select("doc_id")
    return docs.join(materialise(gone, "gone"), "doc_id", "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents of scarce sources twice, those beyond a target not at all."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; the columns of the documents but the text come along."""
    return pieces.encode(docs, [c for c in docs.columns if c != "text"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: zstandard ratios and the pieces of a model can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the mix of the cleaned documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
