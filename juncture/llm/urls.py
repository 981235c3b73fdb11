"""URL filters by cascades of Bloom filters.

Level 0 of a cascade holds the listed keys; level 1 the keys of the corpus that level 0 passes wrongly; level 2 the listed
keys that level 1 passes; and so on until a level passes nothing wrong. Every key of the corpus is tested while the
cascade is built, so its answers for those keys are exact. Each level is sized by the list, not by the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`host` and all its subdomains, paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = tuple(
    Rule(verdict, text[: text.index("/")], text[text.index("/") :])
    for verdict, text in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
)


@dataclass
class Level:
    salt: int
    bits: np.ndarray
    hashes: int

    @classmethod
    def of(cls, pairs: np.ndarray, salt: int, rate: float) -> Level:
        """A filter of (h1, h2) pairs with about that rate of wrong passes."""
        m = 1 << max(6, math.ceil(math.log2(max(1, len(pairs)) * -math.log(rate) / math.log(2) ** 2)))
        k = max(1, round(-math.log2(rate)))
        out = cls(salt, np.zeros(m // 8, dtype="uint8"), k)
        at = out._places(pairs).ravel()
        np.bitwise_or.at(out.bits, at >> 3, np.uint8(1) << (at & 7).astype("uint8"))
        return out

    def _places(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = (pairs[:, 0] ^ np.uint64((self.salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
            a ^= a >> np.uint64(29)
            b = (pairs[:, 1] + np.uint64(self.salt)) * np.uint64(0xC4CEB9FE1A85EC53) | np.uint64(1)
            b ^= (b >> np.uint64(31)) << np.uint64(1)
            steps = np.arange(self.hashes, dtype="uint64")
            h = a[:, None] + steps[None, :] * b[:, None]
            h ^= h >> np.uint64(32)
        return (h & np.uint64(len(self.bits) * 8 - 1)).astype("int64")

    def passes(self, pairs: np.ndarray) -> np.ndarray:
        at = self._places(pairs)
        return ((self.bits[at >> 3] >> (at & 7).astype("uint8")) & 1).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, pairs: np.ndarray) -> np.ndarray:
        """A key that fails at an odd level, or passes all of an odd number of levels, is listed."""
        out, alive = np.full(len(pairs), len(self.levels) % 2 == 1), np.ones(len(pairs), dtype=bool)
        for i, level in enumerate(self.levels):
            at = np.flatnonzero(alive)
            gone = at[~level.passes(pairs[at])] if len(at) else at
            out[gone] = i % 2 == 1
            alive[gone] = False
        return out


def hash_pair(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(11)).alias("_h1"), F.xxhash64(key, F.lit(23)).alias("_h2")]


def _pairs(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in ("_h1", "_h2")], axis=1).astype("int64").view("uint64")


def build_cascade(universe: DataFrame, listed: DataFrame, most_listed: int = 20_000_000, most_levels: int = 64) -> Cascade:
    """A cascade for the keys `listed` (column key) that is exact for all of `universe` (column key).

    The driver holds the list, whose size is checked, and each level's wrong passes: by the choice of rates about 0.7 of the
    list at the first, fewer after. Nothing of the corpus's size is collected: with more wrong passes than that the level is
    made again with a tenth of the rate.
    """
    listed = listed.filter(F.col("key").isNotNull()).select(*hash_pair(F.col("key"))).distinct()
    if (r := listed.count()) > most_listed:
        raise ValueError(f"{r} listed keys; the cascade is made on the driver for at most {most_listed}")
    if not r:
        return Cascade()
    keys = _pairs(listed.toArrow())
    others = universe.filter(F.col("key").isNotNull()).select(*hash_pair(F.col("key")))
    s = max(others.count(), 1)
    rate = min(0.5, math.sqrt(0.5) * r / s)
    bound = 4 * r + 1000
    while True:
        level = Level.of(keys, 1, rate)

        def wrong(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(level.passes(_pairs(batch))))

        passed = others.mapInArrow(wrong, "_h1 long, _h2 long").join(F.broadcast(listed), ["_h1", "_h2"], "left_anti").distinct().limit(bound + 1).toArrow()
        if len(passed) <= bound:
            break
        rate /= 10
    levels, held, against = [level], keys, _pairs(passed)
    while len(against):
        if len(levels) == most_levels:
            raise ValueError(f"{len(against)} keys pass {most_levels} levels")
        level = Level.of(against, len(levels) + 1, 0.5)
        levels.append(level)
        held, against = against, held[level.passes(held)]
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end; else both empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), path


def candidate_keys(host: Column, path: Column, lengths: list[int], depths: list[int]) -> Column:
    """Every key that could fit: each suffix of the host, at a dot, of as many labels as a listed host has, with each start of the
    path of a listed length. A host of thousands of labels gives no more keys than another."""
    labels = F.split(host, r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(labels) >= k, F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")) for k in depths]))
    starts = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct(s.alias("host"), F.concat(s, p).alias("key")))))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (or null), verdict.

    One cascade for each verdict says exactly which candidate keys of a url are listed; the longest wins (by all of the key,
    then by the host). What fits no rule is in no list and gets `otherwise`. A null url, or one without ://, has an empty host
    and path and fits none. Rules with equal keys and unlike verdicts are an error. Repeated rows are judged each.
    """
    if len({r.key for r in rules}) < len({(r.key, r.verdict) for r in rules}):
        raise ValueError("one key has two verdicts")
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    lengths, depths = sorted({len(r.path) for r in rules}), sorted({r.host.count(".") + 1 for r in rules})
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = split.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths, depths))
    universe = keyed.select(F.explode("_keys.key").alias("key"))
    verdicts = sorted({r.verdict for r in rules})
    cascades = [build_cascade(universe, spark.createDataFrame([(r.key,) for r in rules if r.verdict == v], "key string")) for v in verdicts]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("_h1")).to_numpy(zero_copy_only=False))
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
            pairs = np.stack([flat("_h1"), flat("_h2")], axis=1).view("uint64")
            keys, sizes, hosts = batch.column("_names").flatten(), flat("_sizes"), flat("_hosts")
            best: dict[int, tuple] = {}
            for v, cascade in zip(verdicts, cascades, strict=True):
                for i in np.flatnonzero(cascade.contains(pairs)):
                    best[row[i]] = max(best.get(row[i], (-1, -1, "", "")), (sizes[i], hosts[i], keys[int(i)].as_py(), v))
            chosen = [best.get(i, (0, 0, None, otherwise)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([c[2] for c in chosen], pa.string()), pa.array([c[3] for c in chosen], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    listed = keyed.select(
        "page_id", "host", "path",
        F.transform("_keys", lambda k: k["key"]).alias("_names"), F.transform("_keys", lambda k: F.char_length(k["key"])).alias("_sizes"), F.transform("_keys", lambda k: F.char_length(k["host"])).alias("_hosts"),
        F.transform("_keys", lambda k: F.xxhash64(k["key"], F.lit(11))).alias("_h1"), F.transform("_keys", lambda k: F.xxhash64(k["key"], F.lit(23))).alias("_h2"),
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    return listed.mapInArrow(decide, f"page_id {kind}, host string, path string, rule string, verdict string")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM split
), rules(verdict, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
"""
