"""Observed features: a schema's check, its operators as Columns, and trace tables by target."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operators that a type of feature allows; is_null is for nullable ones.
OPERATORS = {
    "boolean": ("eq", "in"),
    "integer": ("eq", "in", "gt", "gte", "lt", "lte"),
    "number": ("eq", "in", "gt", "gte", "lt", "lte"),
    "string": ("eq", "in", "contains", "startswith"),
    "enum": ("eq", "in"),
}


class ObservationError(ValueError):
    """A schema of observed features that contradicts itself."""


@dataclass(frozen=True)
class Observed:
    """A feature that an observer may report."""

    name: str
    type: str
    operators: tuple[str, ...]
    values: tuple | None = None
    nullable: bool = False
    source: str | None = None
    anchor: str | None = None


def _fits(kind: str, value: Any) -> bool:
    if isinstance(value, bool):
        return kind in ("boolean", "enum")
    if isinstance(value, int):
        return kind in ("integer", "number", "enum")
    return kind in ("number", "enum") if isinstance(value, float) else kind in ("string", "enum") if isinstance(value, str) else False


def check_schema(features: list[Observed]) -> None:
    """Names once each, an operator at least and each once, all of them legal for the type; an enum has values, values fit their
    type and come once; an anchor needs a source."""
    seen: set[str] = set()
    for f in features:
        legal = OPERATORS.get(f.type)
        wrong = [o for o in f.operators if o not in (legal or ()) and not (o == "is_null" and f.nullable)]
        problem = (
            "has no name" if not f.name.strip()
            else "is named twice" if f.name in seen
            else f"has the unknown type {f.type!r}" if legal is None
            else "has no operator" if not f.operators
            else "repeats an operator" if len(set(f.operators)) < len(f.operators)
            else f"does not support {wrong}" if wrong
            else "has an anchor without a source" if f.anchor and not f.source
            else "needs values" if (f.type == "enum" and not f.values) or f.values == ()
            else "has values that don't fit its type" if any(not _fits(f.type, v) for v in f.values or ())
            else "repeats a value" if f.values and len({(type(v), v) for v in f.values}) < len(f.values)
            else None
        )
        if problem:
            raise ObservationError(f"feature {f.name!r} {problem}")
        seen.add(f.name)


def observed(f: Observed, operator: str, value: Any = None) -> Column:
    """Whether a row's value stands in that relation; null counts as no, but for is_null."""
    check_schema([f])
    if operator not in f.operators:
        raise ObservationError(f"feature {f.name!r} does not declare {operator!r}")
    if operator == "is_null":
        return F.col(f.name).isNull()
    for v in value if operator == "in" else [value]:
        if not _fits(f.type, v) or (f.type == "enum" and v not in f.values):
            raise ObservationError(f"feature {f.name!r} can't be compared with {v!r}")
    c = F.col(f.name)
    tests = {"eq": lambda: c == value, "in": lambda: c.isin(list(value)), "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value, "contains": lambda: c.contains(value), "startswith": lambda: c.startswith(value)}
    return F.coalesce(tests[operator](), F.lit(False))


def trace_tables(df: DataFrame, features: list[str], targets: dict[str, Column]) -> dict[str, DataFrame]:
    """For each target the features with its label, `allowed` or `denied` (where its predicate holds); and `multi_target`, the
    features with all labels, a column a target. Selections alone: who writes several of them may cache `df`."""
    label = {t: F.when(F.coalesce(c, F.lit(False)), "denied").otherwise("allowed") for t, c in targets.items()}
    clash = set(features) & (set(targets) | {"label"})
    if clash:
        raise ObservationError(f"features and targets share the names {sorted(clash)}")
    kept = [F.col(f"`{f}`") for f in features]
    return {t: df.select(*kept, c.alias("label")) for t, c in label.items()} | {"multi_target": df.select(*kept, *[c.alias(t) for t, c in label.items()])}


def write_trace_tables(df: DataFrame, features: list[str], targets: dict[str, Column], folder: str) -> dict[str, str]:
    """A folder of CSV files with a header for each table of `trace_tables`; their paths by name."""
    held = df.select(*features, *[c.alias(f"_t{i}") for i, c in enumerate(targets.values())]).cache()
    try:
        tables = trace_tables(held, features, {t: F.col(f"_t{i}") for i, t in enumerate(targets)})
        for name, table in tables.items():
            table.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    finally:
        held.unpersist()
    return {name: f"{folder}/{name}" for name in tables}
