"""From documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, written as Parquet
and read again, and returns documents; the last returns the pieces of the
packed sequences. Rows of a stage's result depend on its whole input only, so
a stage can be run again from its predecessor's table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kelpstone.llm import linededup, mixing, neardup, packing, quality
from kelpstone.llm.shared import fresh, scope, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the lines that passed."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share."""
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", pack),
]

#: Near-duplicate classes, seeded selection and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        written = fresh(spark, f"pipeline-{name}")
        with scope(spark):  # what a stage wrote on its way goes when its result is written
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(written)
        docs = spark.read.parquet(written)
    return docs
