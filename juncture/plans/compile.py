"""Policies as Columns: one projection evaluates a policy over any number of rows.

Every evaluator keeps the row's columns and adds its results, so Catalyst prunes what nothing reads and fuses all into one
stage. mode "strict" raises on a missing feature that evaluation reaches; "lenient" reads such a comparison as false.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.plans import expr
from juncture.plans.expr import EPSILON, PolicyError
from juncture.plans.policy import ActionPolicy, FanOut, Feature, Gate, Override, Rule, Staged, content_hash, derived_order, to_json


def _numeric_equal(a: Column, b: Column) -> Column:
    return F.abs(a.cast("double") - b.cast("double")) < F.lit(EPSILON)


class Compiler:
    """Turns trees into boolean Columns over named features."""

    def __init__(self, features: tuple[Feature, ...], mode: str = "strict", columns: dict[str, Column] | None = None) -> None:
        if mode not in ("strict", "lenient"):
            raise PolicyError(f"unknown mode {mode!r}")
        self.mode, self.types = mode, {f.name: f.type for f in features}
        self.columns = dict(columns or {f.name: F.col(f"`{f.name}`") for f in features if not f.derived})
        for f in derived_order(features):
            self.columns[f.name] = derive(f.derived["kind"], *[self.columns[f.derived[s]] for s in ("left", "right")])

    def numeric(self, feature: str) -> bool:
        return self.types[feature] in ("int", "float")

    def leaf(self, x: dict) -> Column:
        name, op = x["feature"], x["op"]
        a, names = self.columns[name], [name]
        number = self.numeric(name)
        if "feature_ref" in x:
            names.append(x["feature_ref"])
            b: Any = self.columns[x["feature_ref"]]
        else:
            b = x["value"]
        if op in ("in", "not_in"):
            # JSON's equality is strict: a value of another type is never equal
            fit = [v for v in b if expr.is_number(v) == number]
            inside = (reduce(Column.__or__, [_numeric_equal(a, F.lit(float(v))) for v in fit]) if number else a.isin(fit)) if fit else F.lit(False)
            out = inside if op == "in" else ~inside
        else:
            b = b if isinstance(b, Column) else F.lit(float(b) if number else b)
            if number:
                a, b = a.cast("double"), b.cast("double")
            if op in ("==", "!="):
                same = _numeric_equal(a, b) if number else a == b
                out = same if op == "==" else ~same
            else:
                out = a > b if op == ">" else a >= b if op == ">=" else a < b if op == "<" else a <= b
        if self.mode == "lenient":
            return F.coalesce(out, F.lit(False))
        for n in reversed(names):
            out = F.when(self.columns[n].isNull(), F.raise_error(F.lit(f"missing feature: {n}")).cast("boolean")).otherwise(out)
        return out

    def tree(self, x: dict) -> Column:
        if "not" in x:
            return ~self.tree(x["not"])
        for k, stop in (("all", False), ("any", True)):
            if k in x:
                parts = [self.tree(c) for c in x[k]]
                if self.mode == "lenient":
                    return reduce(Column.__and__ if k == "all" else Column.__or__, parts)
                # left to right: what follows a decisive child is never evaluated
                out = parts[-1]
                for p in reversed(parts[:-1]):
                    out = F.when(p, F.lit(True) if stop else out).otherwise(out if stop else F.lit(False))
                return out
        return self.leaf(x)


def derive(kind: str, left: Column, right: Column) -> Column:
    """left - right or left / right; 0.0 where the result isn't finite or the denominator is (nearly) zero."""
    left, right = left.cast("double"), right.cast("double")
    if kind == "difference":
        out = left - right
    elif kind == "ratio":
        out = F.when(F.isnan(right) | (F.abs(right) < EPSILON), F.lit(0.0)).otherwise(F.try_divide(left, right))
    else:
        raise PolicyError(f"unknown derived feature: {kind!r}")
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.lit(0.0)).otherwise(out)


def mask_words(matches: list[tuple[int, Column]]) -> Column:
    """array<bigint>: 64 bits a word, at least one word, no zero words at the end."""
    top = max((b for b, _ in matches), default=0) // 64
    words = []
    for w in range(top + 1):
        bits = [F.when(m, F.lit(1 << (b % 64) if b % 64 < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b, m in matches if b // 64 == w]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits) if bits else F.lit(0).cast("long"))
    if top == 0:
        return F.array(words[0])
    used = F.greatest(*[F.when(words[i] != 0, F.lit(i + 1)).otherwise(F.lit(1)) for i in range(top + 1)])
    return F.slice(F.array(*words), 1, used)


def mask_json(words: Column) -> Column:
    """One word as an unsigned number, more as an array of them."""
    unsigned = F.transform(words, lambda w: F.when(w < 0, w.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(w.cast("decimal(20,0)")).cast("string"))
    return F.when(F.size(words) == 1, unsigned[0]).otherwise(F.concat(F.lit("["), F.array_join(unsigned, ","), F.lit("]")))


def test_bit(words: Column, bit: int) -> Column:
    return F.coalesce(F.shiftrightunsigned(F.get(words, F.lit(bit // 64)), bit % 64).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def explained_features(rule: Rule, features: tuple[Feature, ...]) -> list[dict]:
    """For each comparison the feature's label and the state whose (op, value) is the comparison's, without repeats."""
    by, out = {f.name: f for f in features}, []
    for x in expr.leaves(rule.when):
        f = by[x["feature"]]
        state = next((s for s in f.states if s.get("op") == x["op"] and "value" in x and expr.equal(s.get("value"), x["value"])), {})
        one = {"feature": f.name, "label": f.label or expr.humanize(f.name), "state": state.get("label"), "message": state.get("message")}
        if one not in out:
            out.append(one)
    return out


_RULE = "struct<id:string,bit:int,action:string,priority:int,label:string,message:string,severity:string,hint:string,features:array<struct<feature:string,label:string,state:string,message:string>>>"


def _described(rule: Rule, features: tuple[Feature, ...]) -> Column:
    data = {"id": rule.id, "bit": rule.bit, "action": rule.action, "priority": rule.priority, "label": rule.label or expr.label(rule.when), "message": rule.message, "severity": rule.severity, "hint": rule.hint or expr.hint(rule.when), "features": explained_features(rule, features)}
    return F.from_json(F.lit(json.dumps(data)), _RULE)


def _matched(pairs: list[tuple[Column, Column]], empty: str) -> Column:
    return F.array_compact(F.array(*[F.when(m, what) for m, what in pairs])) if pairs else F.from_json(F.lit("[]"), f"array<{empty}>")


def gate_columns(gate: Gate, mode: str = "strict", columns: dict[str, Column] | None = None, explain: bool = False) -> dict[str, Column]:
    """mask, allow and matched_rules (ids in rule order); with explain also rules, policy_hash."""
    c = Compiler(gate.features, mode, columns)
    found = [(r, c.tree(r.when)) for r in gate.rules]
    mask = mask_words([(r.bit, m) for r, m in found])
    out = {"mask": mask, "allow": ~reduce(Column.__or__, [m for _, m in found]) if found else F.lit(True), "matched_rules": _matched([(m, F.lit(r.id)) for r, m in found], "string")}
    if explain:
        out |= {"rules": _matched([(m, _described(r, gate.features)) for r, m in found], _RULE), "policy_hash": F.lit(content_hash(to_json(gate)))}
    return out


def action_columns(policy: ActionPolicy, mode: str = "strict", columns: dict[str, Column] | None = None, explain: bool = False) -> dict[str, Column]:
    """action, defaulted, matched_rules and selected_rules (by priority), candidate_actions, ambiguity."""
    c = Compiler(policy.features, mode, columns)
    rules = policy.ordered()
    found = [(r, c.tree(r.when)) for r in rules]
    matched = _matched([(m, F.struct(F.lit(r.id).alias("id"), F.lit(r.action).alias("action"))) for r, m in found], "struct<id:string,action:string>")
    candidates = F.array_distinct(F.transform(matched, lambda x: x["action"]))
    if policy.mode == "first_match":
        chosen = F.coalesce(*[F.when(m, F.lit(r.action)) for r, m in found]) if found else F.lit(None).cast("string")
    else:
        actions = list(dict.fromkeys(r.action for r in rules))
        votes = []
        for a in actions:
            own = [(r, m) for r, m in found if r.action == a]
            weight = reduce(Column.__add__, [F.when(m, F.lit(max(r.weight, 1)).cast("long")).otherwise(F.lit(0).cast("long")) for r, m in own])
            first = F.least(*[F.when(m, F.lit(i)) for i, (r, m) in enumerate(found) if r.action == a], F.lit(len(found)))
            votes.append(F.when(weight > 0, F.struct((-weight).alias("w"), first.alias("p"), F.lit(a).alias("a"))))
        chosen = F.get(F.array_sort(F.array_compact(F.array(*votes))), F.lit(0))["a"]
    action = F.coalesce(chosen, F.lit(policy.no_match_action or policy.default_action))
    out = {
        "action": action,
        "defaulted": chosen.isNull(),
        "matched_rules": F.transform(matched, lambda x: x["id"]),
        "selected_rules": F.transform(F.filter(matched, lambda x: x["action"] == chosen), lambda x: x["id"]),
        "candidate_actions": candidates,
        "ambiguity": F.when(F.size(candidates) > 1, F.concat(F.lit("several actions match: "), F.array_join(candidates, ", "))),
    }
    if explain:
        out |= {"rules": _matched([(m, _described(r, policy.features)) for r, m in found], _RULE), "policy_hash": F.lit(content_hash(to_json(policy)))}
    return out


def fan_out_columns(policy: FanOut, mode: str = "strict") -> dict[str, Column]:
    """actions (those that apply, in order) and verdicts (action to whether it applies, by name)."""
    on = [(a, ~gate_columns(g, mode)["allow"]) for a, g in policy.gates]
    verdicts = F.map_from_arrays(F.array(*[F.lit(a) for a, _ in sorted(on, key=lambda x: x[0])]), F.array(*[m for _, m in sorted(on, key=lambda x: x[0])]))
    return {"actions": _matched([(m, F.lit(a)) for a, m in on], "string"), "verdicts": verdicts}


def override_columns(policy: Override, mode: str = "strict") -> dict[str, Column]:
    """result (the action, or allow / deny), source (the refinement's name or `base`)."""

    def one(p: Gate | ActionPolicy) -> tuple[Column, Column]:
        if p.kind == "gate":
            c = gate_columns(p, mode)
            return F.when(c["allow"], "allow").otherwise("deny"), ~c["allow"]
        c = action_columns(p, mode)
        return c["action"], (F.size(c["matched_rules"]) > 0) | ~c["defaulted"]

    base, _ = one(policy.base)
    parts = [(name, *one(p)) for name, p in policy.refinements]
    return {
        "result": F.coalesce(*[F.when(fired, r) for _, r, fired in parts], base),
        "source": F.coalesce(*[F.when(fired, F.lit(n)) for n, _, fired in parts], F.lit("base")),
    }


def truthy(c: Column, kind: str) -> Column:
    """null, false, 0, "" and empty collections are false."""
    if kind == "boolean":
        out = c
    elif kind == "string":
        out = c != ""
    elif kind.startswith(("array", "map")):
        out = F.size(c) > 0
    elif kind.startswith("struct"):
        out = F.lit(len(kind) > len("struct<>"))
    else:
        out = c != 0
    return F.coalesce(c.isNotNull() & out, F.lit(False))


def evaluate(df: DataFrame, policy: Any, mode: str = "strict", explain: bool = False) -> DataFrame:
    """`df` with the policy's results added. Evaluates any kind of policy; a staged one adds its output map's columns."""
    kinds = {"gate": lambda p: gate_columns(p, mode, explain=explain), "action": lambda p: action_columns(p, mode, explain=explain), "fan_out": lambda p: fan_out_columns(p, mode), "override": lambda p: override_columns(p, mode)}
    if policy.kind in kinds:
        derived = [f.name for f in getattr(policy, "features", ()) if f.derived and f.name in df.columns]
        if derived:
            raise PolicyError(f"derived features are computed, not supplied: {derived}")
        return df.withColumns(kinds[policy.kind](policy))
    return _staged(df, policy, mode)


def _staged(df: DataFrame, policy: Staged, mode: str) -> DataFrame:
    def resolve(ref: Any) -> Column:
        if isinstance(ref, str) and ref.startswith("@"):
            stage, export = ref[1:].split(".")
            c = F.col(f"`_stage_{stage}`")
            value = c[export]
            return value if mode == "lenient" else F.when(c.isNull(), F.raise_error(F.lit(f"{ref} of a stage that was skipped")).cast(kinds[(stage, export)])).otherwise(value)
        if isinstance(ref, str) and ref.startswith("$."):
            return reduce(lambda c, p: c[p], ref[2:].split(".")[1:], F.col(f"`{ref[2:].split('.')[0]}`"))
        return F.lit(ref)

    kinds: dict[tuple[str, str], str] = {}
    result_kinds = {"bitmask": "array<bigint>", "allow": "boolean", "matched_rules": "array<string>"}
    for s in policy.stages:
        got = gate_columns(s.gate, mode, {name: resolve(ref) for name, ref in s.inputs.items()})
        result = {"bitmask": got["mask"], "allow": got["allow"], "matched_rules": got["matched_rules"]}
        made = F.struct(*[result[path[2:]].alias(name) for name, path in s.exports.items()])
        for name, path in s.exports.items():
            kinds[(s.id, name)] = result_kinds[path[2:]]
        if s.when is not None:
            guard = resolve(s.when)
            made = F.when(truthy(guard, df.select(guard).schema[0].dataType.simpleString()), made)
        df = df.withColumn(f"_stage_{s.id}", made)
    df = df.withColumns({name: resolve(ref) for name, ref in policy.output.items()})
    return df.drop(*[f"_stage_{s.id}" for s in policy.stages])


def near_misses(df: DataFrame, gate: Gate, most_rules: int = 3, most_unmet: int = 8) -> DataFrame:
    """`df` with near_misses: of the rules that don't fire, those with the fewest unmet comparisons (then by bit). Rules are
    chosen by whole numbers; what is unmet is written out for the chosen ones alone."""
    c = Compiler(gate.features, "lenient")
    none = F.array().cast("array<string>")

    def count(x: dict) -> Column:
        if "all" in x:
            return reduce(lambda a, b: a + b, map(count, x["all"]))
        if "any" in x:
            return F.when(c.tree(x), 0).otherwise(reduce(lambda a, b: a + b, map(count, x["any"])))
        return F.lit(0) if "not" in x else F.when(c.leaf(x), 0).otherwise(1)

    def unmet(x: dict) -> Column:
        if "all" in x:
            return F.concat(*map(unmet, x["all"]))
        if "any" in x:
            return F.when(c.tree(x), none).otherwise(F.concat(*map(unmet, x["any"])))
        return none if "not" in x else F.when(c.leaf(x), none).otherwise(F.array(F.lit(expr.label(x))))

    kind = "array<struct<n_unmet:int,bit:int,rule:string,unmet:array<string>>>"
    if not gate.rules:
        return df.withColumn("near_misses", F.array().cast(kind))
    # one whole number a rule, (unmet, place by bit), and -1 if it fires: generated code ranks them, and each is written out once
    rules = sorted(gate.rules, key=lambda r: r.bit)
    keys = F.array(*[F.when(c.tree(r.when), -1).otherwise(count(r.when) * len(rules) + i) for i, r in enumerate(rules)])
    made = df.withColumn("_near", F.slice(F.sort_array(F.array_remove(keys, -1)), 1, most_rules))
    bits, names = F.array(*[F.lit(r.bit) for r in rules]), F.array(*[F.lit(r.id) for r in rules])

    def written(x: Column) -> Column:
        at, missing = x % len(rules), none
        for i, r in reversed(list(enumerate(rules))):
            missing = F.when(at == i, F.slice(unmet(r.when), 1, most_unmet)).otherwise(missing)
        return F.struct(F.floor(x / len(rules)).cast("int").alias("n_unmet"), F.get(bits, at).alias("bit"), F.get(names, at).alias("rule"), missing.alias("unmet"))

    return made.withColumn("near_misses", F.transform("_near", written)).drop("_near")


class Engine:
    """Runs a loaded policy over a DataFrame or a single row."""

    def __init__(self, policy: Any) -> None:
        self.policy = policy.validate()

    @classmethod
    def load(cls, path: str) -> Engine:
        from juncture.plans import policy

        return cls(policy.load(path))

    def transform(self, df: DataFrame, mode: str = "strict", explain: bool = False, coerce: bool = False) -> DataFrame:
        if coerce:
            from juncture.functions.scalars import coerce_to

            wanted = {f.name: f.type for f in getattr(self.policy, "features", ())}
            kinds = dict(df.dtypes)
            df = df.withColumns({n: coerce_to(F.col(n), t) for n, t in wanted.items() if kinds.get(n) == "string" and t in ("bool", "int", "float")})
        return evaluate(df, self.policy, mode, explain)

    def evaluate(self, rows: dict | list[dict]) -> Any:
        """By the interpreter, of one row or of each: a gate's bitmask, an action policy's action, a fan-out's actions."""
        if isinstance(rows, list):
            return [self.evaluate(r) for r in rows]
        if self.policy.kind == "gate":
            return interpret_mask(self.policy, rows)
        if self.policy.kind == "action":
            return interpret_action(self.policy, rows)
        if self.policy.kind == "fan_out":
            return [a for a, g in self.policy.gates if interpret_mask(g, rows)]
        raise PolicyError(f"single rows of kind {self.policy.kind!r} are evaluated as a table of one row")


def interpret_action(policy: ActionPolicy, row: dict) -> str:
    """An action policy's action by the interpreter: the first rule that holds, or the action of most weight (then the earlier one)."""
    row = _with_derived(policy.features, row)
    hits = [r for r in policy.ordered() if expr.holds(r.when, row)]
    if not hits:
        return policy.no_match_action or policy.default_action
    votes: dict[str, int] = {}
    for r in hits:
        votes[r.action] = votes.get(r.action, 0) + max(1, r.weight)
    return max(votes, key=lambda a: votes[a]) if policy.mode == "weighted_vote" else hits[0].action


def interpret_mask(gate: Gate, row: dict) -> int:
    """A gate's mask by the interpreter, derived features included."""
    row = _with_derived(gate.features, row)
    return sum(1 << r.bit for r in gate.rules if expr.holds(r.when, row))


def _with_derived(features: tuple[Feature, ...], row: dict) -> dict:
    row = dict(row)
    for f in derived_order(features):
        if row.get(f.name) is not None:
            raise PolicyError(f"derived feature {f.name!r} is computed, not supplied")
        a, b = (float(row[f.derived[s]]) for s in ("left", "right"))
        v = a - b if f.derived["kind"] == "difference" else 0.0 if b != b or abs(b) < EPSILON else a / b
        row[f.name] = v if v == v and abs(v) != float("inf") else 0.0
    return row
