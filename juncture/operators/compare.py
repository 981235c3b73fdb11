"""Comparison of policies with rows, with each other and with a specification."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from juncture.functions.scalars import row_hash
from juncture.plans import expr
from juncture.plans.compile import Compiler, action_columns, gate_columns, interpret_mask, near_misses
from juncture.plans.policy import ActionPolicy, Gate, Rule

RULES = "rule_id string, bit int, signature string, meta string"


def replay(df: DataFrame, gate: Gate, denied: Column) -> DataFrame:
    """Each row with expected, predicted (both: whether denied), correct, matched_rules."""
    got = gate_columns(gate, "lenient")
    return df.withColumns({"expected": denied, "predicted": ~got["allow"], "matched_rules": got["matched_rules"]}).withColumn("correct", F.col("expected").eqNullSafe(F.col("predicted")))


def replay_actions(df: DataFrame, policy: ActionPolicy, action: str) -> DataFrame:
    """Each row with expected, predicted (the actions), correct, matched_rules."""
    got = action_columns(policy, "lenient")
    return df.withColumns({"expected": F.col(action), "predicted": got["action"], "matched_rules": got["matched_rules"]}).withColumn("correct", F.col("expected").eqNullSafe(F.col("predicted")))


def conflicts(df: DataFrame, gate: Gate, denied: Column) -> DataFrame:
    """The rows where gate and label disagree: row_hash, expected, predicted, matched_rules, near_misses (of denied rows)."""
    names = [f.name for f in gate.features if not f.derived]
    wrong = near_misses(replay(df, gate, denied).filter("not correct"), gate)
    return wrong.select(*names, row_hash(names).alias("row_hash"), "expected", "predicted", "matched_rules", F.when(F.col("expected"), F.col("near_misses")).alias("near_misses"))


def action_conflicts(df: DataFrame, policy: ActionPolicy, action: str) -> DataFrame:
    """The rows where an action policy and the label differ: the features, row_hash, expected, predicted, candidates, matched_rules."""
    names = [f.name for f in policy.features if not f.derived]
    got = action_columns(policy, "lenient")
    said = df.withColumns({"expected": F.col(action), "predicted": got["action"], "candidates": got["candidate_actions"], "matched_rules": got["matched_rules"]})
    wrong = said.filter(~F.col("expected").eqNullSafe(F.col("predicted")))
    return wrong.select(*names, row_hash(names).alias("row_hash"), "expected", "predicted", "candidates", "matched_rules")


def validate_probes(df: DataFrame, gate: Gate, denied: Column, probes: dict[str, dict]) -> DataFrame:
    """probe, matched, fixed (denied rows that the gate misses), introduced (rows that are rightly allowed now), safe (fixes two
    or more and introduces none), for each predicate that might be added to a gate. One pass, whatever the number of probes."""
    c = Compiler(gate.features, "lenient")
    hit = c.tree(expr.union([r.when for r in gate.rules])) if gate.rules else F.lit(False)
    wanted = F.coalesce(denied, F.lit(False))
    aggregates = []
    for i, t in enumerate(probes.values()):
        m = c.tree(t)
        aggregates += [F.count_if(m).alias(f"m{i}"), F.count_if(m & wanted & ~hit).alias(f"f{i}"), F.count_if(m & ~wanted & ~hit).alias(f"i{i}")]
    rows = F.array(*[F.struct(F.lit(n).alias("probe"), F.col(f"m{i}").alias("matched"), F.col(f"f{i}").alias("fixed"), F.col(f"i{i}").alias("introduced")) for i, n in enumerate(probes)])
    return df.agg(*aggregates).select(F.explode(rows).alias("x")).select("x.*").withColumn("safe", (F.col("fixed") >= 2) & (F.col("introduced") == 0))


def adopt(gate: Gate, validated: DataFrame, probes: dict[str, dict]) -> Gate:
    """The gate with the safe probes as rules auto_proposal_001, ..., most fixed rows first."""
    safe = [r["probe"] for r in validated.filter("safe").orderBy(F.desc("fixed"), "probe").collect()]
    first = max((r.bit for r in gate.rules), default=-1) + 1
    more = tuple(Rule(f"auto_proposal_{i + 1:03d}", probes[n], first + i, label=expr.label(probes[n])) for i, n in enumerate(safe))
    return Gate(gate.id, gate.features, (*gate.rules, *more)).validate()


def boundary_probes(spark: SparkSession, gate: Gate, baseline: dict[str, Any]) -> DataFrame:
    """Rows at a threshold and one to either side of it, for each rule of one number, over a baseline row; with the gate's mask."""
    rows = []
    types = {"bool": T.BooleanType(), "int": T.DoubleType(), "float": T.DoubleType(), "string": T.StringType(), "enum": T.StringType()}
    own = [f for f in gate.features if not f.derived]
    for r in gate.rules:
        parts = expr.leaves(r.when)
        if len(parts) == 1 and expr.is_number(parts[0].get("value")) and parts[0]["op"] in (*expr.ORDERED, "==", "!="):
            for d in (-1, 0, 1):
                row = {**baseline, parts[0]["feature"]: parts[0]["value"] + d}
                rows.append((r.id, float(parts[0]["value"] + d), *[float(row[f.name]) if f.type in ("int", "float") else row[f.name] for f in own]))
    schema = T.StructType([T.StructField("probe_rule", T.StringType()), T.StructField("probe_value", T.DoubleType()), *[T.StructField(f.name, types[f.type]) for f in own]])
    made = spark.createDataFrame(rows, schema)
    got = gate_columns(gate, "lenient")
    return made.withColumns({"mask": got["mask"], "allow": got["allow"]})


def cross_check(df: DataFrame, gate: Gate) -> DataFrame:
    """rows, agreed: the compiled gate against the interpreter, on every row, all words of the mask."""
    names = [f.name for f in gate.features if not f.derived]

    def words(mask: int) -> list[int]:
        out = [mask >> at & (1 << 64) - 1 for at in range(0, max(mask.bit_length(), 1), 64)]
        return [w - (1 << 64) if w >> 63 else w for w in out]

    @F.pandas_udf("array<long>")
    def interpreted(rows):
        import pandas as pd

        return pd.Series([words(interpret_mask(gate, {k: (v.item() if hasattr(v, "item") else v) for k, v in r.items()})) for r in rows.to_dict("records")])

    # every row is compiled; rows of equal features and compiled mask are interpreted once
    alike = df.select(*[F.col(f"`{n}`").alias(f"f{i}") for i, n in enumerate(names)], gate_columns(gate)["mask"].alias("compiled")).groupBy("compiled", *[f"f{i}" for i in range(len(names))]).agg(F.count("*").alias("n"))
    both = alike.select("n", "compiled", interpreted(F.struct(*[F.col(f"f{i}").alias(n) for i, n in enumerate(names)])).alias("interpreted"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(total("n").alias("rows"), total(F.when(F.col("compiled") == F.col("interpreted"), F.col("n"))).alias("agreed"))


def rule_table(spark: SparkSession, policy: Gate | ActionPolicy) -> DataFrame:
    """The rules of a gate or an action policy; of the latter the action belongs to what a rule means, priority to its place and
    weight to its metadata."""
    action = policy.kind == "action"
    rows = []
    for r in policy.rules:
        means = f"{r.action}|{expr.signature(r.when)}" if action else expr.signature(r.when)
        about = {"l": r.label, "m": r.message, "s": r.severity} | ({"w": r.weight} if action else {})
        rows.append((r.id, r.priority if action else r.bit, means, expr.key(about)))
    return spark.createDataFrame(rows, RULES)


def rule_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """rule_id, new_id, change: paired by id, what is left by signature (in bit order), the rest added or removed.

    Changes: same, semantic_change, bit_reordered, metadata_changed, renamed, added, removed.
    """
    from pyspark.sql.window import Window

    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    full = o.join(n, F.col("o_rule_id") == F.col("n_rule_id"), "full_outer")
    kind = F.when(F.col("o_signature") != F.col("n_signature"), "semantic_change").when(F.col("o_bit") != F.col("n_bit"), "bit_reordered").when(F.col("o_meta") != F.col("n_meta"), "metadata_changed").otherwise("same")
    paired = full.filter(F.col("o_rule_id").isNotNull() & F.col("n_rule_id").isNotNull()).select(F.col("o_rule_id").alias("rule_id"), F.col("n_rule_id").alias("new_id"), kind.alias("change"))
    nth = lambda side: F.row_number().over(Window.partitionBy(f"{side}_signature").orderBy(f"{side}_bit"))
    gone = full.filter(F.col("n_rule_id").isNull()).select(F.col("o_rule_id").alias("rule_id"), F.col("o_signature").alias("s"), nth("o").alias("k"))
    came = full.filter(F.col("o_rule_id").isNull()).select(F.col("n_rule_id").alias("new_id"), F.col("n_signature").alias("s"), nth("n").alias("k"))
    rest = gone.join(came, ["s", "k"], "full_outer").select("rule_id", "new_id", F.when(F.col("new_id").isNull(), "removed").when(F.col("rule_id").isNull(), "added").otherwise("renamed").alias("change"))
    return paired.unionByName(rest)


def verify(spark: SparkSession, gate: Gate, spec: dict, most: int = 5_000_000) -> dict:
    """Whether a gate denies all that a specification does (complete) and nothing else (sound), with witnesses.

    Each feature takes its thresholds, points between and beyond them, its values, or a fresh string; every combination is
    tried, in Spark. Exact for comparisons with literals; a gate or specification with references or derived features, or
    with more than `most` combinations, gives `unknown`.
    """
    trees = [spec, *[r.when for r in gate.rules]]
    used = list(dict.fromkeys(f for t in trees for f in expr.features(t)))
    by = {f.name: f for f in gate.features}
    if any("feature_ref" in x for t in trees for x in expr.leaves(t)) or any(by[u].derived for u in used):
        return {"complete": "unknown", "sound": "unknown"}
    points: dict[str, list] = {}
    for u in used:
        f = by[u]
        literals = [v for t in trees for x in expr.leaves(t) if x["feature"] == u for v in (x["value"] if isinstance(x["value"], list) else [x["value"]])]
        if f.type == "bool":
            points[u] = [True, False]
        elif f.type == "enum":
            points[u] = list(f.values)
        elif f.type == "string":
            points[u] = sorted({*literals, "\u0000fresh"})
        else:
            at = sorted(set(map(float, literals)))
            mids = [(a + b) / 2 for a, b in itertools.pairwise(at)]
            tried = sorted({*at, *mids, at[0] - 1, at[-1] + 1} | ({x + d for x in at for d in (-1, 1)} if f.type == "int" else set()))
            points[u] = [x for x in tried if (f.min is None or x >= f.min) and (f.max is None or x <= f.max) and (f.type != "int" or x.is_integer())]
    size = 1
    for p in points.values():
        size *= len(p)
    if size > most:
        return {"complete": "unknown", "sound": "unknown"}
    cells = spark.range(size)
    step = 1
    columns = []
    for u, p in points.items():
        columns.append(F.get(F.array(*[F.lit(x) for x in p]), (F.floor(F.col("id") / step) % len(p)).cast("int")).alias(u))
        step *= len(p)
    c = Compiler(gate.features, "lenient", {u: F.col(f"`{u}`") for u in used} | {f.name: F.lit(None) for f in gate.features if f.name not in used})
    wanted, said = c.tree(spec), c.tree(expr.union([r.when for r in gate.rules])) if gate.rules else F.lit(False)
    rows = cells.select(*columns)
    missed, wrong = (rows.filter(x).limit(1).collect() for x in (wanted & ~said, said & ~wanted))
    return {"complete": not missed, "sound": not wrong, "missed": missed[0].asDict() if missed else None, "spurious": wrong[0].asDict() if wrong else None}
