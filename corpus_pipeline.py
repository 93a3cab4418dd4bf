"""From raw documents to a sharded training corpus: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.

Defined cases, in every stage: an empty table gives an empty table with the same
columns; further columns pass through, whatever they are called; texts of any
length are read whole.  What a stage does with nulls and repeated rows it says itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lettergraph.llm import decontaminate, mixing, near_dedup, quality, sharding
from lettergraph.llm._shared import small_batches
from lettergraph.shared import written

SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others; rows that repeat a text share its verdict; a score at the threshold stays.
    Without trusted positives nothing can be learnt: every score is 0.5, below the threshold, and all go.
    """
    small_batches(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Texts without words are linked with nothing and stay; rows with a null id form no links and stay; of rows that repeat the
    id that stays, all with its text do.
    """
    small_batches(spark)
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts have no words and stay; rows that repeat a text share its verdict; an empty benchmark hits nothing.
    """
    small_batches(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for.

    A null source is a source; null texts have size 0; rows that repeat an id are drawn apart, ordered by size, id and text.
    """
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot.

    A null id is a key like others; rows that repeat an id share a shard and get slots of their own.
    """
    return sharding.with_shards(docs, sharding.even_tree(SHARDS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is fitted, so SQL can't give the rows; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
