"""A corpus prepared in five stages: reject bad documents, drop exact and near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes what each stage returns to the shared folder and reads it again.

Defined results: a null or empty text counts as empty, is scored as any other and, having no words, is never taken by the mix; rows
without doc_id are scored, are no near copies of anything, and are taken as units of their own; very long texts go whole through
each stage; repeated rows are scored alike and stay or go together; columns of any other names are carried up to the mix; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import exact_dedup, mixing, near_dedup, pieces, quality
from foliant.llm.common import staged, table, workspace


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, which share four fifths of their five-word shingles."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, in the order of training."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the token ids, and digest of the decoded text, for each document of the mix."""
    return pieces.encoded(docs)


STAGES = [
    ("quality", good),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer are no SQL; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
