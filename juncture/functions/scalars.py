"""Scalar functions: coercion of human-written values, tokens, identifiers, lists, ratios, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE, FALSE = ("true", "yes", "y", "on"), ("false", "no", "n", "off")
#: What counts as a number, and as a whole one; `1d`, `nan` and `inf` don't.
_NUMBER, _WHOLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^[+-]?[0-9]+$"


def token(c: Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(F.trim(c))


def parse_bool(c: Column) -> Column:
    """yes/no/on/off/true/false/y/n in any case; else null."""
    t = token(c)
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def _plain(c: Column) -> tuple[Column, Column, Column]:
    """(digits, whether a percentage, whether in parentheses): one % off the end, one currency sign off the front, commas out."""
    t = F.trim(c)
    percent = t.endswith("%")
    t = F.trim(F.when(percent, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    t = F.trim(F.regexp_replace(t, r"^[$€£¥]", ""))
    minus = t.startswith("(") & t.endswith(")") & (F.length(t) > 2)
    t = F.trim(F.when(minus, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    return F.regexp_replace(t, ",", ""), percent, minus


def parse_number(c: Column) -> Column:
    """A double: `42%` is 0.42, `$1,200` is 1200, `(14)%` is -0.14; null if it isn't a number."""
    t, percent, minus = _plain(c)
    v = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    v = F.when(minus, -v).otherwise(v)
    return F.when(percent, v / 100).otherwise(v)


def parse_whole(c: Column) -> Column:
    """A bigint, for numbers written without a point, an exponent or a %; else null."""
    t, percent, minus = _plain(c)
    v = F.when(t.rlike(_WHOLE) & ~percent, t.try_cast("bigint"))
    return F.when(minus, -v).otherwise(v)


def coerce_to(c: Column, kind: str) -> Column:
    return {"bool": parse_bool, "int": parse_whole, "float": parse_number}.get(kind, F.trim)(c)


def promote(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each string column as what all of its values are: BOOLEAN, BIGINT, DOUBLE, or else trimmed STRING. One pass decides."""
    checks = [f(F.count_if(parse(F.col(f"`{c}`")).isNull() & F.col(f"`{c}`").isNotNull()) == 0, c) for c in columns for f, parse in ((lambda x, c: x.alias(f"b_{c}"), parse_bool), (lambda x, c: x.alias(f"i_{c}"), parse_whole), (lambda x, c: x.alias(f"d_{c}"), parse_number))]
    got = df.agg(*checks).first() if checks else {}
    pick = {c: next((k for k, p in (("bool", "b"), ("int", "i"), ("float", "d")) if got[f"{p}_{c}"]), "string") for c in columns}
    return df.withColumns({c: coerce_to(F.col(f"`{c}`"), k) for c, k in pick.items()})


def plain_scalar(c: Column) -> Column:
    """The strict form of the scoring path, as (kind, text): int, float, bool, or the raw string. No %, currency or yes/no."""
    kind = F.when(c.rlike(_WHOLE) & c.try_cast("bigint").isNotNull(), "int").when(c.rlike(_NUMBER), "float").when(c.isin("true", "false"), "bool").otherwise("string")
    return F.struct(kind.alias("kind"), c.alias("text"))


def boolish(c: Column, kind: str) -> Column:
    """Booleans as they are, whole numbers by <> 0, strings by 1/true/yes/y; floats are false."""
    if kind == "boolean":
        out = c
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        out = c != 0
    elif kind == "string":
        out = F.lower(c).isin("1", "true", "yes", "y")
    else:
        out = F.lit(False)
    return F.coalesce(out, F.lit(False))


def identifier(c: Column) -> Column:
    """What is no ASCII letter or digit becomes `_`."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "_")


def action_list(c: Column) -> Column:
    """array<string>: of a JSON list, or of text divided by , ; or |. Trimmed, without empties, sorted, once each."""
    listed = F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>")
    parts = F.coalesce(listed, F.split(F.coalesce(c, F.lit("")), "[,;|]"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")))


def ratio(n: Column, d: Column) -> Column:
    """n / d; 0.0 for a zero or null denominator."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def row_hash(columns: list[str]) -> Column:
    """sha256 of the columns' JSON, by name."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)])), 256))


def round2(c: Column) -> Column:
    """Scaled, rounded, scaled back: 1.005 becomes 1.01 only if its double times 100 rounds up."""
    return F.round(c * 100) / 100


def fnv1a(text: str) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(T.LongType())
def fnv_bucket(ids, n):
    """fnv1a(id) mod n for whole columns."""
    import pandas as pd

    return pd.Series([None if a is None else fnv1a(a) % int(b) for a, b in zip(ids, n, strict=True)], dtype="Int64")
