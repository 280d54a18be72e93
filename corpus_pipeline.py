"""A training-data pipeline over ``documents``: toxicity, near copies, repeated strings, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.common import scope, table
from tagloom.llm.copies import without_near_copies
from tagloom.llm.mixing import mixed
from tagloom.llm.packing import pack_documents
from tagloom.llm.suffix import without_repeats
from tagloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more leave."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: sets of five-word shingles, linked by a Jaccard similarity of 0.8 or more."""
    return without_near_copies(docs, words=5, similarity=0.8)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every string of 400 bytes and every run of 50 words that starts earlier too; the first place stays."""
    return without_repeats(docs, length=400, words=50)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken up to their targets, documents up to three times."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2,048."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("packing", packing),
]

# A label model, fingerprints and a packing heuristic have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next stage.

    What a stage stores on its way is dropped with its scope, once its result is stored.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scope(spark) as own:
            docs = own.keep(stage(spark, docs, sf_dir))
    return docs
