"""User functions in place of external processes: scalar, batch and row-producing, with checked inputs and outputs.

A plugin is a Python callable that travels to the executors; nothing is spawned there. Batches are Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int, "null": type(None)}
KEYWORDS = {"type", "properties", "required", "items", "additionalProperties", "enum", "const"}


class PluginError(ValueError):
    """A plugin, its input or its answer breaks its contract."""


def check_schema(schema: dict) -> None:
    """Raises for keywords outside the subset."""
    if extra := set(schema) - KEYWORDS:
        raise PluginError(f"unsupported keywords: {sorted(extra)}")
    for s in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_schema(s)


def conforms(value: Any, schema: dict, at: str = "$") -> None:
    """Raises PluginError at the first place where a value doesn't fit."""
    if "type" in schema:
        kind = _TYPES[schema["type"]]
        if not isinstance(value, kind) or (isinstance(value, bool) and schema["type"] in ("number", "integer")):
            raise PluginError(f"{at} is no {schema['type']}")
    if "enum" in schema and value not in schema["enum"]:
        raise PluginError(f"{at} is none of {schema['enum']}")
    if "const" in schema and value != schema["const"]:
        raise PluginError(f"{at} is not {schema['const']!r}")
    if isinstance(value, dict):
        if missing := [k for k in schema.get("required", []) if k not in value]:
            raise PluginError(f"{at} lacks {missing}")
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False and (extra := set(value) - set(known)):
            raise PluginError(f"{at} has unknown fields {sorted(extra)}")
        for k in set(known) & set(value):
            conforms(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            conforms(v, schema["items"], f"{at}[{i}]")


def batch_plugin(function: Callable[[list[dict]], list[Any]], takes: dict | None = None, gives: dict | None = None) -> Callable[[Column], Column]:
    """A Column function from JSON text to JSON text. `function` gets an Arrow batch's inputs at once and must answer each."""
    for s in (takes, gives):
        if s:
            check_schema(s)

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            payloads = [None if x is None else json.loads(x) for x in batch]
            for p in payloads:
                if takes:
                    conforms(p, takes)
            answers = function(payloads)
            if len(answers) != len(payloads):
                raise PluginError(f"{len(answers)} answers to {len(payloads)} inputs")
            for a in answers:
                if gives:
                    conforms(a, gives)
            yield pd.Series([json.dumps(a, sort_keys=True) for a in answers], dtype="object")

    return call


def scalar_plugin(function: Callable[[dict], Any], takes: dict | None = None, gives: dict | None = None) -> Callable[[Column], Column]:
    return batch_plugin(lambda payloads: [function(p) for p in payloads], takes, gives)


def source_plugin(spark: SparkSession, function: Callable[[str], Iterator[dict]], references: list[str], schema: str) -> DataFrame:
    """Rows that `function` gives for each reference; references are dealt over tasks."""
    names = [f.split()[0] for f in schema.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ref in batch["ref"]:
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in function(ref)], columns=names)

    refs = spark.createDataFrame([(r,) for r in references], "ref string").repartition(max(1, len(references)), "ref")
    return refs.mapInPandas(rows, schema)
