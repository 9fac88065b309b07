"""A corpus pipeline of five of the text operators: toxicity, exact and near copies, benchmark passages, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm.decontamination import decontaminate
from sievemark.llm.exact_dedup import exact_dedup
from sievemark.llm.mixing import mix
from sievemark.llm.near_dedup import near_dedup
from sievemark.llm.toxicity import graded_labels, reject_toxic
from sievemark.session import cut


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels of this input, doesn't reject."""
    return reject_toxic(spark, docs, graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal normalised texts: the largest doc_id."""
    return exact_dedup(spark, docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the smallest doc_id."""
    return near_dedup(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contamination rule allows."""
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(spark, docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The toxicity model and the components of similar documents aren't SQL; tests/llm hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a checkpoint between stages stands for the written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
