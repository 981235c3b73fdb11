"""Predicate trees: their shape, checks, canonical form, a small interpreter, and what they cost.

A tree is a dict: {"feature", "op", "value"} or {"feature", "op", "feature_ref"}, {"all": [...]}, {"any": [...]}, {"not": ...}.
"""

from __future__ import annotations

import json
import math
from typing import Any

EPSILON = 2.220446049250313e-16
OPS = ("==", "!=", ">", ">=", "<", "<=", "in", "not_in")
ORDERED = (">", ">=", "<", "<=")
_BY_TYPE = {"bool": ("==", "!="), "enum": ("==", "!=", "in", "not_in"), "string": ("==", "!=", "in", "not_in"), "int": OPS, "float": OPS}


class PolicyError(ValueError):
    """A policy, or a row under it, that has no meaning."""


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def leaf(feature: str, op: str, value: Any) -> dict:
    return {"feature": feature, "op": op, "value": value}


def children(tree: dict) -> list[dict]:
    for k in ("all", "any"):
        if k in tree:
            return tree[k]
    return [tree["not"]] if "not" in tree else []


def leaves(tree: dict) -> list[dict]:
    below = children(tree)
    return [x for c in below for x in leaves(c)] if below else [tree]


def features(tree: dict) -> list[str]:
    """Every feature that a tree reads, in order, once."""
    out: dict[str, None] = {}
    for x in leaves(tree):
        out[x["feature"]] = None
        if "feature_ref" in x:
            out[x["feature_ref"]] = None
    return list(out)


def validate(tree: Any, types: dict[str, dict]) -> None:
    """Raises PolicyError unless every leaf is allowed for its feature. types: name to {"type", "values"?}."""
    if not isinstance(tree, dict):
        raise PolicyError(f"not an expression: {tree!r}")
    for k in ("all", "any"):
        if k in tree:
            if not tree[k]:
                raise PolicyError(f"`{k}` needs at least one expression")
            for c in tree[k]:
                validate(c, types)
            return
    if "not" in tree:
        validate(tree["not"], types)
        return
    feature, op = tree.get("feature"), tree.get("op")
    if feature not in types:
        raise PolicyError(f"unknown feature {feature!r}")
    kind = types[feature]["type"]
    if op not in _BY_TYPE[kind]:
        raise PolicyError(f"operator {op!r} is not allowed for {kind} feature {feature!r}")
    if "feature_ref" in tree:
        other = tree["feature_ref"]
        if other not in types:
            raise PolicyError(f"unknown feature {other!r}")
        numeric = ("int", "float")
        if op in ("in", "not_in") or not (kind == types[other]["type"] or (kind in numeric and types[other]["type"] in numeric)):
            raise PolicyError(f"{feature!r} and {other!r} can't be compared by {op!r}")
        return
    value = tree.get("value")
    several = op in ("in", "not_in")
    if several != isinstance(value, list):
        raise PolicyError(f"operator {op!r} of {feature!r} has the wrong kind of value")
    for v in value if several else [value]:
        good = isinstance(v, bool) if kind == "bool" else is_number(v) if kind in ("int", "float") else isinstance(v, str) if kind == "string" else v in types[feature].get("values", [])
        if not good:
            raise PolicyError(f"value {v!r} doesn't fit {kind} feature {feature!r}")


def equal(a: Any, b: Any) -> bool:
    """Numbers within the double's epsilon; all else strictly by type and value."""
    if is_number(a) and is_number(b):
        return abs(float(a) - float(b)) < EPSILON
    return type(a) is type(b) and a == b


def compare(a: Any, op: str, b: Any) -> bool:
    if op in ("==", "!="):
        return equal(a, b) == (op == "==")
    if op in ("in", "not_in"):
        return any(equal(a, x) for x in b) == (op == "in")
    if not (is_number(a) and is_number(b)):
        raise PolicyError(f"{op} needs numbers, not {a!r} and {b!r}")
    a, b = float(a), float(b)
    return a > b if op == ">" else a >= b if op == ">=" else a < b if op == "<" else a <= b


def holds(tree: dict, row: dict[str, Any], strict: bool = True) -> bool:
    """Interprets a tree left to right. strict: a missing feature that is reached, or an ordering of non-numbers, is an
    error; else such a leaf is false, and `not` over it true."""
    if "all" in tree:
        return all(holds(c, row, strict) for c in tree["all"])
    if "any" in tree:
        return any(holds(c, row, strict) for c in tree["any"])
    if "not" in tree:
        return not holds(tree["not"], row, strict)
    names = [tree["feature"], *([tree["feature_ref"]] if "feature_ref" in tree else [])]
    for name in names:
        if row.get(name) is None:
            if strict:
                raise PolicyError(f"missing feature: {name}")
            return False
    try:
        return compare(row[names[0]], tree["op"], row[names[1]] if len(names) > 1 else tree["value"])
    except PolicyError:
        if strict:
            raise
        return False


def canonical(tree: dict) -> dict:
    """Nested `all` and `any` flattened, children sorted without repeats, lists of `in` sorted, double `not` gone."""
    for k in ("all", "any"):
        if k in tree:
            flat: list[dict] = []
            for c in map(canonical, tree[k]):
                flat += c[k] if k in c else [c]
            unique = {key(c): c for c in flat}
            out = [unique[x] for x in sorted(unique)]
            return out[0] if len(out) == 1 else {k: out}
    if "not" in tree:
        inner = canonical(tree["not"])
        return inner["not"] if "not" in inner else {"not": inner}
    if tree["op"] in ("in", "not_in"):
        values = {json.dumps(v, sort_keys=True): v for v in tree["value"]}
        return {"feature": tree["feature"], "op": tree["op"], "value": [values[x] for x in sorted(values)]}
    return dict(tree)


def key(tree: dict) -> str:
    return json.dumps(tree, sort_keys=True, separators=(",", ":"))


def signature(tree: dict) -> str:
    """Equal for trees that differ in order, nesting or repeats alone."""
    return key(canonical(tree))


def complexity(tree: dict, derived: set[str] = frozenset()) -> int:
    """3 for each numeric ==, 2 for a derived feature, 1 for a feature reference, 1 for each further conjunct."""
    own = leaves(tree)
    cost = len(own) - 1
    for x in own:
        cost += 3 * (x["op"] == "==" and is_number(x.get("value"))) + 2 * (x["feature"] in derived) + ("feature_ref" in x)
    return cost


def memorization(tree: dict, coverage: int) -> float:
    """Large for trees that name single numbers, larger the fewer rows they cover."""
    return max(0.0, 1e6 - coverage) if any(x["op"] == "==" and is_number(x.get("value")) for x in leaves(tree)) else 0.0


def union(trees: list[dict]) -> dict:
    return trees[0] if len(trees) == 1 else {"any": trees}


def unmet(tree: dict, row: dict[str, Any]) -> list[dict]:
    """The leaves that keep a tree from holding: of `all` the unmet ones, of `any` all unless one holds, of `not` none."""
    if "all" in tree:
        return [x for c in tree["all"] for x in unmet(c, row)]
    if "any" in tree:
        return [] if any(holds(c, row, False) for c in tree["any"]) else [x for c in tree["any"] for x in unmet(c, row)]
    if "not" in tree:
        return []
    return [] if holds(tree, row, False) else [tree]


_WORDS = {"==": "is", "!=": "is not", ">": "above", ">=": "at least", "<": "below", "<=": "at most", "in": "one of", "not_in": "none of"}
_TURN = {"==": "!=", "!=": "==", ">": "<=", ">=": "<", "<": ">=", "<=": ">", "in": "not_in", "not_in": "in"}


def humanize(feature: str) -> str:
    for end, said in (("_pct", " (%)"), ("_usd", " (USD)")):
        if feature.endswith(end):
            return feature[: -len(end)].replace("_", " ").strip().capitalize() + said
    return feature.replace("__", " ").replace("_", " ").strip().capitalize()


def _value(feature: str, v: Any) -> str:
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    if isinstance(v, list):
        return ", ".join(_value(feature, x) for x in v)
    return f"{v}%" if is_number(v) and feature.endswith("_pct") else str(v)


def label(tree: dict) -> str:
    """A reader's sentence for a tree."""
    if "all" in tree:
        return " and ".join(map(label, tree["all"]))
    if "any" in tree:
        return " or ".join(map(label, tree["any"]))
    if "not" in tree:
        return f"not ({label(tree['not'])})"
    other = humanize(tree["feature_ref"]) if "feature_ref" in tree else _value(tree["feature"], tree["value"])
    return f"{humanize(tree['feature'])} {_WORDS[tree['op']]} {other}"


def hint(tree: dict) -> str:
    """What would keep a tree from holding."""
    if "all" in tree:
        return " or ".join(map(hint, tree["all"]))
    if "any" in tree:
        return " and ".join(map(hint, tree["any"]))
    if "not" in tree:
        return f"Make it so that {label(tree['not'])}"
    turned = {**tree, "op": _TURN[tree["op"]]}
    return f"Change it so that {label(turned)}"


def round3(v: float) -> float:
    """To three decimals, halves away from zero."""
    return math.copysign(math.floor(abs(v) * 1000 + 0.5) / 1000, v) if v else 0.0
