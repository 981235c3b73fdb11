"""What the operators of this subpackage share: checkpoints, folds and bounded labelled samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where it names none, a new local one, but on a cluster
    that is an error: other machines could not read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if sc.getCheckpointDir() is None:
        named = named or tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(named)
    return named


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Rows go to Python in batches of at most `most` bytes, so that long texts don't add up; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= most:
            return
    except ValueError:
        pass  # a setting with a unit
    spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the session's shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the session's shared folder: smaller than a checkpoint, for tables of many rows."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of (doc_id, text), by which rows are told apart where ids repeat or are null."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def of_rows(docs: DataFrame, keys: DataFrame, how: str, most: int = 4_000_000) -> DataFrame:
    """docs joined with `keys` by _row: broadcast up to `most` of them, by a shuffle beyond."""
    return docs.join(F.broadcast(keys) if keys.count() <= most else keys, "_row", how)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. Texts of nothing but ASCII take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone: the same on each retry of a task."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def one_text_each(docs: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    """(*keep, text): of each id in `ids` (doc_id and `keep`; a bounded sample) the non-null text of least hash, however many
    rows share the id, so that what is learned from has no more rows than `ids`."""
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids.select("doc_id", *keep)), "doc_id")
    return found.groupBy("doc_id", *keep).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(*keep, "text")


def bounded_sample(df: DataFrame, stratum: Column, key: Column, n: int, most_strata: int = 4096) -> DataFrame:
    """At most n rows of each stratum, the same on each run: those with the least uniform(key).

    Rows with a null stratum take no part; more than most_strata strata are an error. Only (stratum, key) are read to
    count; the rows are then filtered by a threshold for each stratum, and the exact cut is made on that small rest.
    """
    df = df.withColumn("_stratum", stratum.cast("string")).withColumn("_u", uniform(key)).filter(F.col("_stratum").isNotNull())
    counts = df.groupBy("_stratum").count()
    if len(counts.limit(most_strata + 1).collect()) > most_strata:
        raise ValueError(f"more than {most_strata} classes to learn")
    chance = (F.lit(n) + 6 * n**0.5) / F.col("count")
    few = df.join(F.broadcast(counts), "_stratum").filter((F.col("count") <= n) | (F.col("_u") < chance))
    nth = F.row_number().over(Window.partitionBy("_stratum").orderBy("_u", key))
    return few.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_u", "_nth", "count")
