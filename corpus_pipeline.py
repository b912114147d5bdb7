"""A training-data pipeline over ``documents``: language, near copies, repeated passages, packing.

Each stage works on all that the one before kept. Columns beyond those of ``documents`` travel along, an empty table gives
empty tables, and rows with null text or without a letter end at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import language, order_minhash, packing, passages
from reviewlake.llm.common import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network knows; those without a letter, or of no clear language, go."""
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least id."""
    return order_minhash.keep_first(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents of nothing else go."""
    return passages.cut_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; one row per piece."""
    return packing.with_checksum(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1))


STAGES = [("language", identify), ("near copies", drop_near_copies), ("passages", cut_passages), ("packing", pack)]

# Learnt languages, alignments and token ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
