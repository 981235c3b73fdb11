"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

quality -> near duplicates -> benchmark decontamination -> mixing -> shards. Each stage works on all that the one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from juncture.llm import decontaminate, mixing, neardup, quality, shard
from juncture.llm.common import checkpoint_folder, table

#: Shares of tokens: toxic text is cut to a fiftieth, clean text keeps its own tokens.
TARGETS = {"clean": 0.98, "toxic": 0.02}
#: Jaccard similarity of five-word shingles that makes near copies here; op7 asks for 85.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours vote down go; ties stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.score_documents(docs, model).filter("score >= 0.5").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id. Similarity of at least NEAR_PERCENT links two; rows equal
    in id and text are copies as well."""
    return neardup.one_of_each(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go, each judged by its own text whatever its id."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the fitted rates ask for."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), TARGETS, reference="clean")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, shard, slot...: where each remaining document is to be written."""
    return shard.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned and iterative stages can't be written in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages the documents lie in the shared folder that the session names for checkpoints."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
