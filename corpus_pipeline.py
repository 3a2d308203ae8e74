"""Corpus cleaning in stages, from the documents table to packed sequences.

Every stage works on all rows that the stage before it kept, and its result is written as Parquet and read
again: a lost executor costs one stage's tasks.  All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm.near_copies import one_of_near_copies
from parcelflow.llm.op1_substring_dedup import without_repeats
from parcelflow.llm.op3_language_id import keep_languages
from parcelflow.llm.op6_best_fit_packing import best_fit_packing
from parcelflow.llm.op9_decontaminate import clean_documents
from parcelflow.llm.registry import table
from parcelflow.sources.storage import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    return keep_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-word Jaccard similarity of 0.8 or more the one with the smallest doc_id stays."""
    return one_of_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeats of 20-word windows are cut out; all documents stay."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences."""
    return best_fit_packing(docs, carry=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has neither XXH64 nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
