"""Profiles of columns, drift between classes, label inference, governance hints, and generated traces."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from juncture.functions.scalars import token

BINS, TOP, THRESHOLD = 10, 3, 0.15
# Tokens of the two classes of a binary label.
POSITIVE = ("1", "true", "yes", "y", "allow", "allowed", "approve", "approved", "grant", "granted", "pass", "passed", "ok", "safe", "benign")
NEGATIVE = ("0", "false", "no", "n", "deny", "denied", "reject", "rejected", "block", "blocked", "flag", "flagged", "fail", "failed", "unsafe", "malicious")
PREFERRED = ("allowed", "label", "decision", "outcome", "approved", "target", "result", "verdict")


def unpivot(df: DataFrame, columns: list[str], *keep: Column) -> DataFrame:
    """(*keep, field, value): one row for each column of each row; values as strings."""
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_x")).select(*[k for k in df.select(*keep).columns], "_x.*")


def unpivot_numbers(df: DataFrame, columns: list[str], *keep: Column) -> DataFrame:
    """(*keep, field, v): as `unpivot`, values as doubles."""
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_x")).select(*[k for k in df.select(*keep).columns], "_x.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, rows, nulls, distinct, multi (rows whose text lists several values): values are counted first, then summed, so a
    frequent value is one row after the map side."""
    counts = unpivot(df, columns).groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("field").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count_if(F.col("value").isNotNull()).alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").rlike("[,;|]"), F.col("n"))), F.lit(0)).alias("multi"))


def value_examples(df: DataFrame, columns: list[str], k: int = TOP) -> DataFrame:
    """field, rank, value, n: the k commonest values of each column (ties by value)."""
    counts = unpivot(df, columns).filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def discrete_drift(df: DataFrame, columns: list[str], denied: Column) -> DataFrame:
    """field, drift: half the sum of |share among denied - share among allowed| over values (null is a value)."""
    counts = unpivot(df, columns, denied.alias("_d")).groupBy("field", "value").agg(F.count_if("_d").alias("d"), F.count_if(~F.col("_d")).alias("a"))
    totals = counts.groupBy("field").agg(F.sum("d").alias("nd"), F.sum("a").alias("na"))
    shares = counts.join(F.broadcast(totals), "field")
    return shares.groupBy("field").agg((F.sum(F.abs(F.try_divide("d", "nd") - F.try_divide("a", "na"))) * 0.5).alias("drift"))


def numeric_drift(df: DataFrame, columns: list[str], denied: Column, bins: int = BINS) -> DataFrame:
    """field, drift, mean_denied, mean_allowed: total variation of histograms of equal width over the pooled range."""
    numbers = unpivot_numbers(df, columns, denied.alias("_d")).filter(F.col("v").isNotNull())
    ranges = numbers.groupBy("field").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor(F.least(F.greatest((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(0.999999)) * bins)).otherwise(0)
    binned = numbers.join(F.broadcast(ranges), "field").groupBy("field", at.alias("bin")).agg(F.count_if("_d").alias("d"), F.count_if(~F.col("_d")).alias("a"), F.sum(F.when(F.col("_d"), F.col("v"))).alias("sd"), F.sum(F.when(~F.col("_d"), F.col("v"))).alias("sa"))
    totals = binned.groupBy("field").agg(F.sum("d").alias("nd"), F.sum("a").alias("na"), F.sum("sd").alias("td"), F.sum("sa").alias("ta"))
    return binned.join(F.broadcast(totals), "field").groupBy("field").agg((F.sum(F.abs(F.try_divide("d", "nd") - F.try_divide("a", "na"))) * 0.5).alias("drift"), F.max(F.try_divide("td", "nd")).alias("mean_denied"), F.max(F.try_divide("ta", "na")).alias("mean_allowed"))


def drift_report(df: DataFrame, numeric: list[str], discrete: list[str], denied: Column, nuisance: list[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """field, drift, suspicious (a nuisance field that drifts more than the threshold), most drift first."""
    parts = ([numeric_drift(df, numeric, denied).select("field", "drift")] if numeric else []) + ([discrete_drift(df, discrete, denied)] if discrete else [])
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.withColumn("suspicious", F.col("field").isin(list(nuisance)) & (F.col("drift") > threshold)).orderBy(F.desc("drift"), "field")


def label_domain(df: DataFrame, column: str) -> list[str]:
    """The label's tokens, if there are one or two; else an error."""
    got = [r[0] for r in df.select(token(F.col(f"`{column}`").cast("string")).alias("t")).distinct().limit(3).collect()]
    if not got or len(got) > 2 or None in got:
        raise ValueError(f"{column!r} is no binary label: {sorted(map(str, got))}")
    return sorted(got)


def denied_column(df: DataFrame, column: str, negative: str | None = None) -> Column:
    """Whether a row is denied, by its label's token: a known negative, or the one that is named."""
    domain = label_domain(df, column)
    if negative is None:
        found = [t for t in domain if t in NEGATIVE] or ([] if all(t in POSITIVE for t in domain) else [t for t in domain if t not in POSITIVE])
        if len(domain) == 2 and len(found) != 1:
            raise ValueError(f"which of {domain} denies? name it")
        negative = found[0] if found else ""
    return token(F.col(f"`{column}`").cast("string")) == negative.strip().lower()


def infer_label(df: DataFrame) -> str:
    """The one column with a binary domain of known tokens; a preferred name wins; several are an error. One pass, two kept values a column."""
    checks = []
    for i, c in enumerate(df.columns):
        t = token(F.col(f"`{c}`").cast("string"))
        checks += [F.count_if(~t.isin(*POSITIVE, *NEGATIVE) | t.isNull()).alias(f"bad{i}"), F.count_if(t.isin(*POSITIVE)).alias(f"pos{i}"), F.count_if(t.isin(*NEGATIVE)).alias(f"neg{i}")]
    row = df.agg(*checks).first()
    fit = [c for i, c in enumerate(df.columns) if row[f"bad{i}"] == 0 and row[f"pos{i}"] and row[f"neg{i}"]]
    best = [c for name in PREFERRED for c in fit if c.lower() == name][:1] or fit
    if len(best) != 1:
        raise ValueError(f"no single label column: {fit}")
    return best[0]


def infer_target(df: DataFrame) -> list[dict]:
    """Columns that may be a target: {"field", "kind" (gate, fan_out or action), "score", "confidence"}, best first."""
    profile = {r["field"]: r for r in column_profile(df, df.columns).collect()}
    out = []
    for c in df.columns:
        p, name = profile[c], c.lower()
        if re.search(r"(^|_)(id|uuid|hash|timestamp|created|updated|email)($|_)", name) or p["nulls"]:
            continue
        kind = "gate" if p["distinct"] <= 2 else "fan_out" if p["multi"] else "action" if p["distinct"] <= 64 else None
        if kind is None:
            continue
        score = 40 + 30 * (kind == "gate") + 50 * (name in PREFERRED or bool(re.search(r"action|route|decision|label", name))) - p["distinct"] // 4
        out.append({"field": c, "kind": kind, "score": score, "confidence": "high" if score >= 90 else "medium" if score >= 55 else "low"})
    return sorted(out, key=lambda x: (-x["score"], x["field"]))


def governance(fields: dict[str, str], nuisance: list[str] = ()) -> dict[str, str | None]:
    """Hints for boolean fields: never (not to be used), true_only, or none."""
    def of(name: str, kind: str) -> str | None:
        if kind != "bool":
            return None
        if name in nuisance or re.search(r"(^|_)(nuisance|noise|random|seed)($|_)", name):
            return "never"
        return "true_only" if re.match(r"(has|is|contains|mentions|requests|detected)_", name) else None

    return {name: of(name, kind) for name, kind in fields.items()}


def feature_dictionary(names: list[str]) -> dict[str, dict]:
    """A starter: a label, a kind, a unit and which direction is better, by name."""
    from juncture.plans.expr import humanize

    def of(n: str) -> dict:
        unit = "percent" if re.search(r"(_pct|_percent|_rate)$", n) else "usd" if re.search(r"(_usd|amount|price|balance|income)", n) else "days" if n.endswith("_days") else None
        kind = "flag" if re.match(r"(has|is)_", n) else "count" if re.search(r"(_count|^n_|num_)", n) else "ratio" if re.search(r"(_ratio|_rate|_pct)$", n) else "amount" if unit == "usd" else "value"
        better = True if re.search(r"score|income|balance|tenure", n) else False if re.search(r"debt|risk|error|late|delinq|fraud", n) else None
        return {"label": humanize(n), "kind": kind, "unit": unit, "higher_is_better": better}

    return {n: of(n) for n in names}


@dataclass(frozen=True)
class Field:
    """A generated field: numeric in [low, high], or one of `values` by weight."""

    name: str
    low: float = 0.0
    high: float = 1.0
    values: tuple = ()
    weights: tuple = ()
    nuisance: bool = False


def generate_traces(spark: SparkSession, n: int, fields: list[Field], denied: str, seed: int = 42, least_share: float = 0.2, attempts: int = 20) -> DataFrame:
    """n rows of the fields with `allowed`, at least `least_share` of each class: candidates are drawn in rising numbers (at
    most `attempts` times n) until both classes suffice. `denied` is a SQL predicate over the fields that are no nuisance.

    Every value is a hash of (row, field, seed), so a lost task gives the same rows again. Nuisance fields don't depend on
    the class.
    """
    def value(f: Field) -> Column:
        u = F.pmod(F.xxhash64(F.col("id"), F.lit(f.name), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        if not f.values:
            return F.lit(f.low) + u * (f.high - f.low)
        weights = f.weights or (1.0,) * len(f.values)
        out, at = F.lit(f.values[-1]), 1.0
        for v, w in list(zip(f.values, weights, strict=True))[:0:-1]:
            at -= w / sum(weights)
            out = F.when(u < at, F.lit(f.values[f.values.index(v) - 1])).otherwise(out)
        return out

    least = max(1, int(n * least_share))
    factor = 1
    while True:
        drawn = spark.range(n * factor).select("id", *[value(f).alias(f.name) for f in fields]).withColumn("allowed", ~F.expr(denied))
        count = drawn.agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("d")).first()
        if min(count["a"], count["d"]) >= least:
            break
        if factor >= attempts:
            raise ValueError(f"the predicate gives {count['a']} allowed and {count['d']} denied of {n * factor}")
        factor = min(attempts, factor * 2)
    share = min(max(count["d"] / (n * factor), least_share), 1 - least_share)
    want = {True: n - round(n * share), False: round(n * share)}
    parts = [drawn.filter(F.col("allowed") == k).orderBy("id").limit(v) for k, v in want.items()]
    return parts[0].unionByName(parts[1]).drop("id")
