"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juncture.llm import decontaminate, language, lines, mixing, neardup, neighbours, quality, shard, toxicity, urls
from juncture.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Shares of tokens that op4 asks for.
MIX = {"clean": 0.9, "junk": 0.05, "toxic": 0.05}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_of_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_decontamination": op1_decontamination, "op2_lines": op2_lines, "op6_neighbours": op6_neighbours, "op7_near_duplicates": op7_near_duplicates, "op3_quality": op3_quality, "op4_mixing": op4_mixing, "op5_urls": op5_urls, "op8_shards": op8_shards, "op9_language": op9_language, "op10_toxicity": op10_toxicity}
SQL = {"op1_decontamination": decontaminate.SQL, "op5_urls": urls.SQL, "op7_near_duplicates": neardup.SQL}
