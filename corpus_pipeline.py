"""The corpus pipeline: each stage takes the documents that the one before kept. Its last stage gives their tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from studyperf.llm import bpe, decontaminate, nearcopies, quality, secrets
from studyperf.llm.common import stored
from studyperf.llm.queries import TOKENIZER, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. It learns from the stage's own documents and their labels."""
    return quality.select(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return nearcopies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.masked(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path(TOKENIZER))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokenize),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
