"""The corpus pipeline: stages over the documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of documents; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import exact, language, leaks, near, pieces
from parlance.llm.common import documents, staged

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model is learned from the labelled rows of the input."""
    return language.keep_identified(docs, language.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest doc_id."""
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_bytes=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, pieces and lossless: whether decoding gives back the text."""
    return pieces.encode(docs, pieces.read_vocabulary(VOCABULARY), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

# Language by compression, sketches and keyed merges are not SQL; tests hold run() against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
