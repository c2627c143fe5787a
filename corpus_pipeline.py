"""A corpus pipeline: quality, near duplicates, benchmark passages, mixing, sharding.

Each stage takes all that its predecessor kept, written as Parquet and read again; so
the predecessor's intermediate tables can go when a stage begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from odarel.llm import decontaminate, jaccard, mixing, quality, sharding
from odarel.llm.shared import materialize, owned_by, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run_stage: Stage) -> Stage:
    """Delete what the stages before wrote on their way, then run this one."""

    @wraps(run_stage)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with owned_by("pipeline"):
            return run_stage(spark, docs, sf_dir)

    return whole


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier, trained on the labelled documents here, rejects."""
    return quality.accepted_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


@_stage
def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window of words with a benchmark item."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out and repeat documents so that sources come to their targets."""
    return mixing.mixed_rows(docs)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add size, shard and slot."""
    return sharding.histogram_shards(docs, shards=24)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: SQL can't express the classifier, the join or the random mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
