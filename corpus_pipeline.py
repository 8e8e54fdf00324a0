"""From raw documents to packed sequences, in five stages.

Each stage works on what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm.mixing import mixed
from tallyrank.llm.near_duplicates import distinct_documents
from tallyrank.llm.packing import packed
from tallyrank.llm.substrings import without_repeats
from tallyrank.llm.toxicity import learn, toxicity
from tallyrank.session import materialize

TOXIC = 0.3
#: Columns that stages read or change by name.
USED = ("doc_id", "text", "source", "n_chars")


def _aside(stage: Callable) -> Callable:
    """``stage`` with all other columns carried through under names it does not work with."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in USED else f"carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run


@_aside
def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below 0.3.

    It learns from the labels that the query of the operator learns from.
    """
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scored = toxicity(docs, learn(docs, labels))
    return scored.where(F.col("score") < TOXIC).select(docs.columns)


@_aside
def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return distinct_documents(docs)


@_aside
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that one with a smaller id has as well.

    A text that loses words is its other words joined by spaces; ``n_chars`` follows.
    A document that loses all of them stays, empty.
    """
    out = without_repeats(docs, carried=[c for c in docs.columns if c != "text"])
    out = out.select("n_removed", F.col("kept_text").alias("text"), "carried.*")
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars.cast("long")).select(docs.columns)


@_aside
def weighed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, whole documents, up to three times each, by finish time."""
    return mixed(docs).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", harmless),
    ("near_duplicates", once),
    ("substring_dedup", unrepeated),
    ("mixing", weighed),
    ("packing", sequences),
]

#: No stage but the mix can be said in SQL; the tests hold each against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
