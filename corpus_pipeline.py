"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of ``documents``; the last one returns pieces of packed windows. The
second stage learns from labels, which SQL cannot express, so there is no SQL for the whole; tests hold the rules, the
join and the packing against brute force, and of the classifier and the mix that they keep a subset of their input.

Defined cases: documents with null or empty texts are rejected by the first stage, as any text of fewer words than its
rules want; very long texts go through whole; a null source is a host without a verdict and a source of its own in the
mix; rows with a null id are no one's near duplicates; of repeated rows one stays; ties are broken as the operators
say; columns beside those of ``documents`` come through whatever their names; an empty table gives an empty result.

A stage's working tables are deleted when the next stage begins, since what it returned has been written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import mixing, packing, quality, rules, similarity
from lodestar.sources.workspace import made, materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of the stage before.
_BEFORE: list[str] = []


def _tidy(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs, _BEFORE)
        held = set(made())
        out = stage(spark, docs, sf_dir)
        _BEFORE[:] = [p for p in made() if p not in held]
        return out

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules by document and by host."""
    return rules.keep_good(docs)


@_tidy
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on positives and unlabelled text accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = ~F.coalesce(quality.crc_mod("doc_id", 3) == 1, F.lit(False))
    net = quality.train(docs, labels, learn)
    return quality.score(docs, net).filter("predicted = 1").select("row.*")


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return similarity.representatives(docs)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of their virtual finish times, as often as the mix takes them."""
    return mixing.schedule(mixing.fair_queue(docs))


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), stage.__name__)
    return STAGES[-1][1](spark, docs, sf_dir)
