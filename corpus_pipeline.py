"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before kept; its rows are written as Parquet in the cluster's
shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import cut, table
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.mixing import mix, mixing_plan
from vellum.llm.near_join import near_dedup
from vellum.llm.packing import best_fit_packing
from vellum.llm.quality import keep_quality

#: The mixture takes each document at most once here, so that a document is packed once.
MAX_EPOCHS = 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix within its budget stays."""
    return mix(docs, mixing_plan(docs, max_epochs=MAX_EPOCHS)).select("_doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_join", near_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier's scores are not SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
