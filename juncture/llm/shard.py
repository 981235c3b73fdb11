"""Sharding by sampled splitters: shards of near equal bytes, in the order of one key.

Keys are drawn with a chance in proportion to a record's size, quantiles of the draws bound many small ranges, ranges that
turn out overfull are drawn from again and divided, and whole-number prefix sums over the ranges place each record.
The text never moves: one scan reduces it to (key, size), and only those few bytes are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from juncture.llm.common import cut, uniform


def range_of(keys: list[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    """For each key (arrays of its two parts), how many splitters are at or below it."""
    (major, minor), (s_major, s_minor) = keys, splits
    low, high = np.searchsorted(s_major, major, "left"), np.searchsorted(s_major, major, "right")
    out = low.copy()
    for value in np.unique(major[high > low]):
        at = major == value
        a, b = np.searchsorted(s_major, value, "left"), np.searchsorted(s_major, value, "right")
        out[at] = a + np.searchsorted(s_minor[a:b], minor[at], "right")
    return out


def _assign(df: DataFrame, splits: list[np.ndarray]) -> DataFrame:
    @F.pandas_udf(T.IntegerType())
    def assign(major: pd.Series, minor: pd.Series) -> pd.Series:
        return pd.Series(range_of([major.to_numpy(), minor.to_numpy()], splits).astype("int32"))

    return df.withColumn("_range", assign("_major", "_minor"))


def _draw(df: DataFrame, rate: Column, salt: int) -> list[tuple]:
    return df.filter(uniform(F.col("_major"), F.col("_minor"), F.lit(salt)) < rate).select("_major", "_minor").collect()


def splitters(df: DataFrame, ranges: int, draws_a_range: int = 32, rounds: int = 12, seed: int = 7) -> DataFrame:
    """Adds `_range`: size-weighted quantile ranges of (_major, _minor), about `ranges` of them. Overfull ones are drawn from and
    divided again until none is left that has unlike keys (or `rounds` have passed).

    The driver holds about ranges * draws_a_range keys and one sum for each range, however many records there are.
    """
    total = df.agg(F.sum("_size")).first()[0] or 0
    draws = sorted(map(tuple, _draw(df, F.col("_size") * F.lit(ranges * draws_a_range / max(total, 1)), seed)))
    picked = sorted(set(draws[draws_a_range::draws_a_range]))
    for more in range(rounds):
        splits = [np.array([p[i] for p in picked], dtype="int64") for i in (0, 1)]
        out = _assign(df, splits)
        sums = out.groupBy("_range").agg(F.sum("_size").alias("b"), F.count("*").alias("n"), F.min(F.struct("_major", "_minor")).alias("least"), F.max(F.struct("_major", "_minor")).alias("most"))
        full = sums.filter((F.col("b") > 2 * total / ranges) & (F.col("least") != F.col("most")) & (F.col("n") > 4)).collect()
        if not full or more == rounds - 1:
            return out
        rates = [(row["_range"], 4.0 * draws_a_range * max(1, round(row["b"] * ranges / total)) / row["b"]) for row in full]
        again = out.join(F.broadcast(df.sparkSession.createDataFrame(rates, "_range int, _rate double")), "_range")
        drawn = sorted(set(map(tuple, _draw(again, F.col("_size") * F.col("_rate"), seed + more + 1))))
        picked = sorted({*picked, *drawn[:: 2 * draws_a_range]})
    return out


def shard_by_bytes(records: DataFrame, shards: int, major: Column, minor: Column, size: Column, keep: list[Column], target_range_bytes: int = 16 << 20, most_ranges: int = 4096) -> DataFrame:
    """Puts records into `shards` contiguous ranges of the order (major, minor) whose sums of `size` are near equal.

    Adds `_size`, `shard` (int) and `slot` (long: the record's place in its shard, gapless from 0) to the columns `keep`.
    A shard's sum differs from the mean by less than the largest record. Records with equal (major, minor, size) are
    interchangeable. Null parts of the key sort first; a null size counts as 0; no records give no rows.
    """
    narrow = cut(records.select(*keep, F.coalesce(major.cast("long"), F.lit(-(1 << 63))).alias("_major"), F.coalesce(minor.cast("long"), F.lit(-(1 << 63))).alias("_minor"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size")))
    total = narrow.agg(F.sum("_size")).first()[0] or 0
    ranges = int(min(most_ranges, max(8 * shards, total // target_range_bytes)))
    ranged = cut(splitters(narrow, ranges))
    sums = ranged.groupBy("_range").agg(F.sum("_size").alias("b")).orderBy("_range").collect()
    before, rows = 0, []
    for row in sums:
        rows.append((row["_range"], before))
        before += row["b"]
    offsets = F.broadcast(records.sparkSession.createDataFrame(rows, "_range int, _before long"))
    inside = Window.partitionBy("_range").orderBy("_major", "_minor", "_size")
    placed = (
        ranged.join(offsets, "_range")
        .withColumn("_at", F.col("_before") + F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn("shard", F.least(F.floor((F.col("_at") + F.col("_size") / 2) * shards / max(total, 1)), F.lit(shards - 1)).cast("int"))
    )
    placed = cut(placed)
    pieces = placed.groupBy("shard", "_range").agg(F.count("*").alias("n"), F.min("_rank").alias("first")).orderBy("_range", "shard").collect()
    start: dict[int, int] = {}
    rows = []
    for row in pieces:
        rows.append((row["shard"], row["_range"], start.get(row["shard"], 0) - row["first"]))
        start[row["shard"]] = start.get(row["shard"], 0) + row["n"]
    shift = F.broadcast(records.sparkSession.createDataFrame(rows, "shard int, _range int, _shift long"))
    return placed.join(shift, ["shard", "_range"]).withColumn("slot", F.col("_rank") + F.col("_shift")).drop("_range", "_rank", "_shift", "_at", "_before", "_major", "_minor")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    The order is (hash of the text, doc_id): equal texts lie side by side, in one shard unless a boundary of equal bytes
    falls within them. A null text has size 1, a null checksum, and sorts first; a null doc_id sorts first among its equals;
    repeated rows each get a slot; an empty table gives no rows.
    """
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    keep = [F.col("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32")]
    key = F.when(text.isNotNull(), F.xxhash64(text))
    placed = shard_by_bytes(docs, shards, key, F.col("doc_id"), size, keep)
    return placed.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
