"""Measures of labelled rows: parity, reliability, confusion, sets, splits, conflicts. Each is one aggregate or one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from juncture.functions.scalars import ratio, row_hash
from juncture.plans.compile import Compiler
from juncture.plans.policy import Gate


def parity(df: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """rows, correct, parity. Nulls are equal to each other alone."""
    return df.agg(F.count("*").alias("rows"), F.count_if(expected.eqNullSafe(predicted)).alias("correct")).withColumn("parity", ratio(F.col("correct"), F.col("rows")))


def confusion(df: DataFrame, positive: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, fpr (and the keys of `by`). A null prediction counts as negative; rows without a
    known label are left out."""
    known, said = df.filter(positive.isNotNull()), F.coalesce(predicted, F.lit(False))
    counts = [F.count_if(positive & said).alias("tp"), F.count_if(~positive & said).alias("fp"), F.count_if(~positive & ~said).alias("tn"), F.count_if(positive & ~said).alias("fn")]
    out = known.groupBy(*(by or [])).agg(*counts)
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def rule_reliability(df: DataFrame, gate: Gate, denied: Column, examples: int = 0) -> DataFrame:
    """For each rule: matched, denied_hits, allowed_hits, precision, recall, fpr, lift; with `examples` also a list of the
    `examples` least row hashes among the rows that it matches. All rules are counted in one pass, whatever their number."""
    c = Compiler(gate.features, "lenient")
    aggregates = [F.count("*").alias("_n"), F.count_if(denied).alias("_d")]
    names = [x.name for x in gate.features if not x.derived]
    for i, r in enumerate(gate.rules):
        m = c.tree(r.when)
        aggregates += [F.count_if(m).alias(f"m{i}"), F.count_if(m & denied).alias(f"d{i}")]
    whole = df.agg(*aggregates)
    fields = lambda i, r: [F.lit(r.id).alias("rule"), F.col(f"m{i}").alias("matched"), F.col(f"d{i}").alias("denied_hits")]
    rows = whole.select("_n", "_d", F.explode(F.array(*[F.struct(*fields(i, r)) for i, r in enumerate(gate.rules)])).alias("x")).select("_n", "_d", "x.*")
    base = ratio(F.col("_d"), F.col("_n"))
    precision = ratio(F.col("denied_hits"), F.col("matched"))
    out = rows.withColumns({"allowed_hits": F.col("matched") - F.col("denied_hits"), "precision": precision, "recall": ratio(F.col("denied_hits"), F.col("_d")), "fpr": ratio(F.col("matched") - F.col("denied_hits"), F.col("_n") - F.col("_d")), "lift": ratio(precision, base)})
    if examples:
        hits = df.select(row_hash(names).alias("_h"), F.explode(F.array_compact(F.array(*[F.when(c.tree(r.when), F.lit(r.id)) for r in gate.rules]))).alias("rule")).distinct()
        least = hits.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("_h"))).filter(F.col("_k") <= examples)
        out = out.join(least.groupBy("rule").agg(F.array_sort(F.collect_list("_h")).alias("examples")), "rule", "left")
    return out.drop("_n", "_d")


def fan_out_metrics(df: DataFrame, expected: str, predicted: str, actions: list[str]) -> DataFrame:
    """For each action tp, fp, fn, recall, precision, and over all the share of rows whose two sets are equal."""
    want, got = (lambda a, c=c: F.coalesce(F.array_contains(c, a), F.lit(False)) for c in (expected, predicted))
    same = F.array_sort(F.array_distinct(F.coalesce(F.col(expected), F.array().cast("array<string>")))) == F.array_sort(F.array_distinct(F.coalesce(F.col(predicted), F.array().cast("array<string>"))))
    aggregates = [F.count("*").alias("_n"), F.count_if(same).alias("_same")]
    for i, a in enumerate(actions):
        aggregates += [F.count_if(want(a) & got(a)).alias(f"tp{i}"), F.count_if(~want(a) & got(a)).alias(f"fp{i}"), F.count_if(want(a) & ~got(a)).alias(f"fn{i}")]
    rows = df.agg(*aggregates).select("_n", "_same", F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, a in enumerate(actions)])).alias("x"))
    return rows.select("x.*", ratio(F.col("x.tp"), F.col("x.tp") + F.col("x.fn")).alias("recall"), ratio(F.col("x.tp"), F.col("x.tp") + F.col("x.fp")).alias("precision"), ratio(F.col("_same"), F.col("_n")).alias("exact_set_match"))


def benchmark_summary(df: DataFrame, expected: str, actual: str, category: str) -> DataFrame:
    """category (null for all), cases, exact_match, attack_catch, benign_pass, false_positive: one pass over grouping sets."""
    attack, caught = F.col(expected) != "allow", F.col(actual) != "allow"
    aggregates = [F.count("*").alias("cases"), F.avg((F.col(expected) == F.col(actual)).cast("double")).alias("exact_match"), ratio(F.count_if(attack & caught), F.count_if(attack)).alias("attack_catch"), ratio(F.count_if(~attack & ~caught), F.count_if(~attack)).alias("benign_pass"), ratio(F.count_if(~attack & caught), F.count_if(~attack)).alias("false_positive")]
    return df.groupingSets([[], [F.col(category)]], F.col(category)).agg(*aggregates).withColumnRenamed(category, "category")


def heldout_scores(df: DataFrame, targets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each target (label, prediction) tp, tn, fp, fn and rates; the row `macro` has the means of the rates."""
    aggregates = []
    for i, (want, got) in enumerate(targets.values()):
        w, g = F.coalesce(want, F.lit(False)), F.coalesce(got, F.lit(False))
        aggregates += [F.count_if(w & g).alias(f"tp{i}"), F.count_if(~w & ~g).alias(f"tn{i}"), F.count_if(~w & g).alias(f"fp{i}"), F.count_if(w & ~g).alias(f"fn{i}")]
    rows = df.agg(*aggregates).select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "tn", "fp", "fn")]) for i, t in enumerate(targets)])).alias("x")).select("x.*")
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    rows = rows.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), total), "catch": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "false_positive": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    none = F.lit(None).cast("long")
    macro = rows.agg(*[F.avg(c).alias(c) for c in ("accuracy", "catch", "false_positive")]).select(F.lit("macro").alias("target"), *[none.alias(k) for k in ("tp", "tn", "fp", "fn")], "accuracy", "catch", "false_positive")
    return rows.unionByName(macro)


def exact_conflicts(df: DataFrame, features: list[str], denied: Column) -> DataFrame:
    """Groups of rows with equal features and unlike labels: the features, n_denied, n_allowed."""
    return df.groupBy(*features).agg(F.count_if(denied).alias("n_denied"), F.count_if(~denied).alias("n_allowed")).filter("n_denied > 0 and n_allowed > 0")


def support(df: DataFrame, action: str) -> DataFrame:
    return df.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n"))


def stratified_split(df: DataFrame, strata: list[str], key: Column, share: float) -> DataFrame:
    """`df` with is_train: in each stratum the floor(n * share) rows of least sha256(key), at least one and not all of more
    than one. Ranks are exact; a stratum that is too large for one task's sort spills, so name strata accordingly."""
    size = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    hashed = df.withColumn("_h", F.sha2(key.cast("binary"), 256))
    # a threshold of the first hex digits leaves few rows to rank: counts by prefix, summed over at most 65536 prefixes
    prefix = F.substring("_h", 1, 4)
    by_prefix = hashed.groupBy(*strata, prefix.alias("_p")).agg(F.count("*").alias("_c"))
    run = Window.partitionBy(*strata).orderBy("_p")
    wanted = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * share)))).otherwise(F.col("_n"))
    before = by_prefix.withColumn("_before", F.sum("_c").over(run) - F.col("_c")).join(size, strata).withColumn("_left", wanted - F.col("_before")).select(*strata, "_p", "_c", "_left")
    joined = hashed.withColumn("_p", prefix).join(before, [*strata, "_p"])
    inside = Window.partitionBy(*strata, "_p").orderBy("_h")
    return joined.withColumn("is_train", F.when(F.col("_left") >= F.col("_c"), True).when(F.col("_left") <= 0, False).otherwise(F.row_number().over(inside) <= F.col("_left"))).drop("_h", "_p", "_c", "_left")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """added, removed and common counts of the distinct rows of two one-column tables."""
    name = left.columns[0]
    both = left.select(F.col(name).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(right.columns[0]).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    one = both.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return one.agg(F.count_if(F.col("r") > F.col("l")).alias("added"), F.count_if(F.col("l") > F.col("r")).alias("removed"), F.count_if(F.col("l") == F.col("r")).alias("common"))
