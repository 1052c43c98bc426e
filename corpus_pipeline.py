"""Corpus pipeline: rules, near-duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  The first three return the columns of ``documents``; the last
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.near_dedup import one_of_each
from strandlake.llm.packing import pack_documents
from strandlake.llm.quality_rules import passing
from strandlake.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return passing(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return one_of_each(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters of 100-byte strings that also start earlier go."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("suffix_dedup", repeated_substrings), ("packing", packing)]
#: Signatures, cutoffs and tokens are beyond SQL; the operators are tested against brute force, the stages not yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
