"""Streams: stateless policy scores, and rates by window with a watermark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juncture.plans.compile import evaluate


def read(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 64) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def scores(stream: DataFrame, policy: Any, mode: str = "lenient") -> DataFrame:
    """Each row with the policy's results. A row that lacks a feature isn't an error, so that one row can't stop a stream."""
    return evaluate(stream, policy, mode)


def windowed_rates(stream: DataFrame, time: str, denied: Column, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, rows, denied, rate of each window; on a stream, rows later than the watermark are left out. A time without a zone
    is taken in the session's and given back without one."""
    plain = dict(stream.dtypes)[time] == "timestamp_ntz"
    if plain:
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    kept = stream.withWatermark(time, late).groupBy(F.window(F.col(time), every).alias("w"))
    counts = kept.agg(F.count("*").alias("rows"), F.count_if(denied).alias("denied"))
    start = F.col("w.start").cast("timestamp_ntz") if plain else F.col("w.start")
    return counts.select(start.alias("start"), "rows", "denied", (F.col("denied") / F.col("rows")).alias("rate"))


def drift_from(rates: DataFrame, baseline: float, most: float = 0.15) -> DataFrame:
    """Windows with the difference of their rate from the baseline's, and whether it is too large."""
    return rates.withColumn("difference", F.abs(F.col("rate") - baseline)).withColumn("drifted", F.col("difference") > most)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there now to Parquet and ends; a second call takes up what has come since."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
