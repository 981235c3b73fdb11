"""Policies: gates, action policies, fan-outs, overriding and staged pipelines, as checked dataclasses with JSON forms."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from juncture.plans import expr
from juncture.plans.expr import PolicyError


@dataclass(frozen=True)
class Feature:
    name: str
    type: str
    values: tuple = ()
    min: float | None = None
    max: float | None = None
    label: str | None = None
    #: {"kind": "difference" | "ratio", "left", "right"}
    derived: dict | None = None
    #: [{"op", "value", "label", "message"}]
    states: tuple = ()


@dataclass(frozen=True)
class Rule:
    id: str
    when: dict
    bit: int = 0
    action: str | None = None
    priority: int = 0
    weight: int = 1
    label: str | None = None
    message: str | None = None
    severity: str | None = None
    hint: str | None = None
    rank: int = 0


def _types(features: tuple[Feature, ...]) -> dict[str, dict]:
    return {f.name: {"type": f.type, "values": list(f.values)} for f in features}


def derived_order(features: tuple[Feature, ...]) -> list[Feature]:
    """Derived features, each after what it is made from. A cycle is an error that names its path."""
    by = {f.name: f for f in features}
    out: list[Feature] = []
    done: set[str] = set()

    def visit(name: str, path: list[str]) -> None:
        if name in path:
            raise PolicyError("derived features form a cycle: " + " -> ".join([*path[path.index(name) :], name]))
        f = by.get(name)
        if f is None:
            raise PolicyError(f"unknown feature {name!r}")
        if f.derived and name not in done:
            for side in ("left", "right"):
                visit(f.derived[side], [*path, name])
            done.add(name)
            out.append(f)

    for f in features:
        visit(f.name, [])
    return out


@dataclass(frozen=True)
class Gate:
    """Rules that deny; a row is allowed if none matches."""

    id: str
    features: tuple[Feature, ...]
    rules: tuple[Rule, ...]
    kind: str = "gate"

    def validate(self) -> Gate:
        if len({f.name for f in self.features}) < len(self.features):
            raise PolicyError("a feature is declared twice")
        if len({r.bit for r in self.rules}) < len(self.rules):
            raise PolicyError("two rules share a bit")
        if len({r.id for r in self.rules}) < len(self.rules):
            raise PolicyError("two rules share an id")
        derived_order(self.features)
        for r in self.rules:
            expr.validate(r.when, _types(self.features))
        return self


@dataclass(frozen=True)
class ActionPolicy:
    """Rules that name actions, by priority; `first_match` or `weighted_vote`."""

    id: str
    features: tuple[Feature, ...]
    rules: tuple[Rule, ...]
    default_action: str
    no_match_action: str | None = None
    mode: str = "first_match"
    kind: str = "action"

    def validate(self) -> ActionPolicy:
        if self.mode not in ("first_match", "weighted_vote"):
            raise PolicyError(f"unknown mode {self.mode!r}")
        if len({r.priority for r in self.rules}) < len(self.rules):
            raise PolicyError("two rules share a priority")
        derived_order(self.features)
        for r in self.rules:
            if not r.action:
                raise PolicyError(f"rule {r.id!r} has no action")
            expr.validate(r.when, _types(self.features))
        return self

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: r.priority)


@dataclass(frozen=True)
class FanOut:
    """A gate for each action; an action applies if its gate has a match."""

    id: str
    gates: tuple[tuple[str, Gate], ...]
    kind: str = "fan_out"

    def validate(self) -> FanOut:
        if len({a for a, _ in self.gates}) < len(self.gates):
            raise PolicyError("an action is listed twice")
        for _, g in self.gates:
            g.validate()
        return self


@dataclass(frozen=True)
class Override:
    """A base policy and refinements, of which the first that fires replaces its result."""

    id: str
    base: Any
    refinements: tuple[tuple[str, Any], ...]
    kind: str = "override"

    def validate(self) -> Override:
        for p in (self.base, *(p for _, p in self.refinements)):
            if p.kind not in ("gate", "action"):
                raise PolicyError(f"an override can't hold a {p.kind}")
            p.validate()
        return self


@dataclass(frozen=True)
class Stage:
    id: str
    gate: Gate
    #: feature to `$.path`, `@stage.export` or a literal
    inputs: dict
    #: export to `$.path` of the result (bitmask, allow)
    exports: dict = field(default_factory=lambda: {"bitmask": "$.bitmask", "allow": "$.allow"})
    when: Any = None
    foreach: Any = None


@dataclass(frozen=True)
class Staged:
    """Gates in order, each fed from the row and from what earlier stages export."""

    id: str
    stages: tuple[Stage, ...]
    output: dict
    kind: str = "staged"

    def validate(self) -> Staged:
        known: dict[str, set] = {}
        for s in self.stages:
            if s.gate.kind != "gate":
                raise PolicyError("a stage holds a gate")
            s.gate.validate()
            if s.id in known:
                raise PolicyError(f"stage {s.id!r} is listed twice")
            for ref in [*s.inputs.values(), s.when, s.foreach]:
                check_reference(ref, known)
            known[s.id] = set(s.exports)
        for ref in self.output.values():
            check_reference(ref, known)
        return self


def check_reference(ref: Any, known: dict[str, set]) -> None:
    if isinstance(ref, str) and ref.startswith("@"):
        parts = ref[1:].split(".")
        if len(parts) != 2 or parts[0] not in known or parts[1] not in known[parts[0]]:
            raise PolicyError(f"{ref!r} names no export of an earlier stage")
    if isinstance(ref, str) and ref.startswith("$") and not (ref.startswith("$.") and all(p and not p.isdigit() and "[" not in p for p in ref[2:].split("."))):
        raise PolicyError(f"{ref!r} is no path of named fields")


def compose(id: str, gates: list[Gate], inputs: dict[str, str]) -> Staged:
    """Chains gates, each fed by the features' own paths (`$.TODO_x` where none is given)."""
    stages = tuple(Stage(g.id, g, {f.name: inputs.get(f.name, f"$.TODO_{f.name}") for f in g.features if not f.derived}) for g in gates)
    output = {f"{g.id}_bitmask": f"@{g.id}.bitmask" for g in gates}
    return Staged(id, stages, output).validate()


def to_json(policy: Any) -> dict:
    return json.loads(json.dumps(asdict(policy)))


def _features(rows: list[dict]) -> tuple[Feature, ...]:
    return tuple(Feature(**{**r, "values": tuple(r.get("values") or ()), "states": tuple(r.get("states") or ())}) for r in rows)


def from_json(data: dict) -> Any:
    kind = data.get("kind")
    rest = {k: v for k, v in data.items() if k != "kind"}
    if kind in ("gate", "action"):
        rest |= {"features": _features(data["features"]), "rules": tuple(Rule(**r) for r in data["rules"])}
        return (Gate if kind == "gate" else ActionPolicy)(**rest).validate()
    if kind == "fan_out":
        return FanOut(data["id"], tuple((a, from_json(g)) for a, g in data["gates"])).validate()
    if kind == "override":
        return Override(data["id"], from_json(data["base"]), tuple((n, from_json(p)) for n, p in data["refinements"])).validate()
    if kind == "staged":
        return Staged(data["id"], tuple(Stage(**{**s, "gate": from_json(s["gate"])}) for s in data["stages"]), data["output"]).validate()
    raise PolicyError(f"unknown kind of policy: {kind!r}")


def content_hash(value: Any) -> str:
    """sha256 of JSON with sorted keys."""
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def save(policy: Any, folder: str | Path, extra: dict[str, Any] | None = None) -> Path:
    """A bundle: policy.json, a manifest with its kind, id and hash, and further JSON members."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    data = to_json(policy)
    members = {"policy": "policy.json"}
    (folder / "policy.json").write_text(json.dumps(data, indent=1))
    for name, value in (extra or {}).items():
        members[name] = f"{name}.json"
        (folder / f"{name}.json").write_text(json.dumps(value, indent=1))
    manifest = {"format": 1, "kind": policy.kind, "id": policy.id, "hash": content_hash(data), "members": members}
    (folder / "manifest.json").write_text(json.dumps(manifest, indent=1))
    return folder


def load(path: str | Path) -> Any:
    """From a bundle, its manifest, or a bare policy file. Members outside the bundle and other content than the manifest's hash are errors."""
    path = Path(path)
    if path.is_dir():
        path = path / "manifest.json"
    data = json.loads(path.read_text())
    if "members" not in data:
        return from_json(data)
    root, member = path.parent.resolve(), (path.parent / data["members"]["policy"]).resolve()
    if root not in member.parents:
        raise PolicyError(f"member {data['members']['policy']!r} lies outside the bundle")
    content = json.loads(member.read_text())
    if content_hash(content) != data["hash"]:
        raise PolicyError("the policy isn't what the manifest's hash says")
    return from_json(content)
