"""The corpus pipeline: stages of (spark, docs, sf_dir) that each take what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleanloom.llm import langid, lines, mixing, sentencepieces, simhash
from cleanloom.llm._common import Scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned."""
    return langid.accepted(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are nearly alike one stays."""
    return lines.deduplicated(spark, docs)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents one stays."""
    return simhash.keep_one(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by temperature weights; a document is there once for each epoch of its source."""
    return mixing.mixture(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return sentencepieces.encoded(spark, docs)


STAGES = [
    ("language ID", identify),
    ("line dedup", deduplicate_lines),
    ("SimHash near-dedup", deduplicate_documents),
    ("mixing", mix),
    ("SentencePiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.cut(docs, f"stage{k}")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
