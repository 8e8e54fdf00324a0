"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm import chat, hard_negatives, mixing, subvectors
from tallyrank.llm.near_duplicates import near_duplicates
from tallyrank.llm.neighbours import nearest
from tallyrank.llm.packing import packed
from tallyrank.llm.personal_data import personal_data
from tallyrank.llm.phrases import compared_with_edits
from tallyrank.llm.quality_model import describe, fit, quality
from tallyrank.llm.substrings import without_repeats
from tallyrank.llm.token_counts import token_counts
from tallyrank.llm.toxicity import learn, toxicity
from tallyrank.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_circulant_minhash")
def op3(spark, root):
    return near_duplicates(table(spark, root, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_fixed_block_anchors")
def op6(spark, root):
    return without_repeats(table(spark, root, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _fold(column: str, parts: int):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(-1))


@query("op7_positive_unlabelled_quality")
def op7(spark, root):
    described = materialize(describe(table(spark, root, "documents")), "described")
    labels = table(spark, root, "labels").where(_fold("doc_id", 3) != 1)
    scored = quality(described, fit(described, labels))
    return scored.select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op9_pattern_grammar_toxicity")
def op9(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, root, "labels").where(_fold("doc_id", 4) != 2))
    return toxicity(docs, model).select(
        "doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _edits(text):
    """Three edits of each text: its first word goes, a sentence enters at a third, two thirds on a bit is doubled."""
    n = F.length(text)
    first = F.coalesce(F.locate(" ", text), F.lit(0))
    edit = lambda at, removed, added: F.struct(
        at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed") if isinstance(removed, int)
        else removed.cast("long").alias("removed"), added.alias("added"))
    third, late = F.floor(n / 3), F.floor(n * 2 / 3)
    return F.array(edit(F.lit(0), first, F.lit("")), edit(third, 7, F.lit("'s new, 2nd part ")),
                   edit(late, 0, F.substring(text, 1, 40)))


@query("op1_edit_aware_tokens")
def op1(spark, root):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, root, "documents").select("doc_id", "text", _edits(text).alias("edits"))
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op8_sum_of_squares_packing")
def op8(spark, root):
    return packed(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_budgeted_chat_windows", chat.SQL)
def op2(spark, root):
    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    turns = turns.union(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    read = chat.read_back(chat.windows(turns))
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op4_fair_queueing_mix", mixing.SQL)
def op4(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "source", "text")
    return mixing.served(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_multi_index_hashing")
def op5(spark, root):
    return nearest(table(spark, root, "embeddings"))


@query("op10_consistent_parsing")
def op10(spark, root):
    return compared_with_edits(table(spark, root, "documents"))


@query("op12_subvector_dictionaries", subvectors.SQL)
def op12(spark, root):
    return subvectors.clusters(table(spark, root, "embeddings"))


@query("op13_strassen_hard_negatives", hard_negatives.SQL)
def op13(spark, root):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, root, "embeddings"), label)


@query("op11_skip_chain_field")
def op11(spark, root):
    return personal_data(table(spark, root, "documents"))
