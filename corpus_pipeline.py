"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs. All
but the last return the columns of the documents that they keep:

  toxicity        documents that the classifiers call toxic go
  exact_dedup     of rows with equal texts one stays
  near_dedup      of each group of near copies one document stays
  decontaminate   benchmark passages are cut; a document that is mostly such passages goes
  packing         what is left is packed into windows

Defined results: each stage has those of its operator. Rows with a null or empty text pass all filters but the exact one, which keeps
one empty text, and have no tokens to pack. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontaminate, exact_dedup, packing, simhash_dedup, toxicity
from larder.runtime import materialize


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_repeats(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_copies(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("packing", _packing),
]
#: Classifiers, signature search and least squares can't be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the packed windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
