"""Learning of policies: gates by greedy and exact choice of predicates, actions by covering, fan-outs one against the rest."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.operators.mining import ATOMS, Candidate, Cells, atoms, cell_table, conjunctions, finer, kinds_of, threshold_coverage
from juncture.plans import expr
from juncture.plans.compile import Compiler, derive
from juncture.plans.policy import ActionPolicy, FanOut, Feature, Gate, Rule

LOOKAHEAD, BRUTE, SHORTLIST, RARE, PASSES = 12, 16, 96, 24, 3
#: Partial choices that the exact step looks at beyond BRUTE candidates before it settles for the best one seen.
MOST_NODES = 20_000
_TYPES = {"number": "float", "bool": "bool", "string": "string"}


@dataclass(frozen=True)
class Goal:
    """`balanced`: fewest errors. `recall`: at least `recall` of the denied rows, with at most `fpr` of the allowed ones."""

    kind: str = "balanced"
    recall: float = 0.95
    fpr: float = 0.05

    def key(self, train: tuple, held: tuple, nd: int, na: int, rules: int, cost: int) -> tuple:
        """Smaller is better. train and held are (missed, wrong) of the rows that train and of those kept for validation."""
        (missed, wrong), (held_missed, held_wrong) = train, held
        if self.kind == "balanced":
            return (missed + wrong, held_missed + held_wrong, wrong, held_wrong, rules, cost, missed, held_missed)
        over = wrong > math.floor(self.fpr * na)
        short = nd - missed < math.ceil(self.recall * nd)
        if over:
            return (1, 0, wrong, missed, held_missed + held_wrong, rules, cost)
        if short:
            return (0, 1, missed, wrong, held_missed + held_wrong, rules, cost)
        return (0, 0, wrong, held_wrong, held_missed + held_wrong, rules, cost, missed)

    def general(self, train: tuple, held: tuple, nd: int, na: int, rules: int, cost: int) -> tuple:
        """The order by which rules are made more general: errors on rows kept for validation come first."""
        if self.kind != "balanced":
            return self.key(train, held, nd, na, rules, cost)
        return (sum(held), held[1], sum(train), train[1], rules, cost, held[0], train[0])


@dataclass
class Plan:
    cells: Cells
    goal: Goal
    chosen: list[Candidate] = field(default_factory=list)

    def key(self, chosen: list[Candidate] | None = None, order: str = "key") -> tuple:
        chosen = self.chosen if chosen is None else chosen
        c = self.cells
        hit = np.logical_or.reduce([x.mask for x in chosen]) if chosen else np.zeros(len(c.denied), bool)
        errors = [(int(d.sum()) - int(d[hit].sum()), int(a[hit].sum())) for d, a in ((c.denied, c.allowed), (c.held_denied, c.held_allowed))]
        return getattr(self.goal, order)(*errors, int(c.denied.sum()), int(c.allowed.sum()), len(chosen), sum(expr.complexity(x.tree) for x in chosen))

    def uncovered(self) -> np.ndarray:
        if not self.chosen:
            return self.cells.denied
        return np.where(np.logical_or.reduce([c.mask for c in self.chosen]), 0, self.cells.denied)


def candidates(cells: Cells, left: np.ndarray, most_conditions: int) -> list[Candidate]:
    singles = atoms(cells, left, ATOMS)
    return sorted(singles + conjunctions(cells, left, singles, most_conditions), key=lambda c: c.order)


def shortlist(found: list[Candidate], n: int) -> list[Candidate]:
    """The n of most signal and the n that gain most rows: a wide predicate of strong signal has so many neighbours, with edges a
    threshold away, that by signal alone they leave no place to a narrow one without errors."""
    gaining = sorted(found, key=lambda c: (c.allowed - c.denied, c.order))[:n]
    return list({expr.signature(c.tree): c for c in [*found[:n], *gaining]}.values())


def greedy(plan: Plan, most_rules: int, most_conditions: int) -> None:
    """Adds the candidate after which (and after the best next one of the same pool) the plan is best, while it gets better."""
    while len(plan.chosen) < most_rules:
        pool = shortlist(candidates(plan.cells, plan.uncovered(), most_conditions), LOOKAHEAD)
        before, best = plan.key(), None
        for c in pool:
            one = plan.key([*plan.chosen, c])
            two = min((plan.key([*plan.chosen, c, n]) for n in pool if n is not c), default=one)
            if one < before and (best is None or (min(one, two), one) < best[0]):
                best = ((min(one, two), one), c)
        if best is None:
            break
        plan.chosen.append(best[1])


def exact(cells: Cells, pool: list[Candidate], goal: Goal, most_nodes: int = MOST_NODES) -> list[Candidate]:
    """The best subset of up to SHORTLIST candidates by the goal's key.

    Up to BRUTE of them every subset is compared: sums over subsets of patterns give all errors at once. Beyond, branch and
    bound: what is chosen is wrong already, what all others together would miss is missed in any case. A search that has not
    ended after `most_nodes` partial choices returns the best one seen.
    """
    pool = pool[:SHORTLIST]
    k = len(pool)
    if k > BRUTE:
        return _branch_and_bound(cells, pool, goal, most_nodes)
    bits = np.zeros(len(cells.denied), dtype="int64")
    for i, c in enumerate(pool):
        bits |= c.mask.astype("int64") << i
    sums = []
    for w in (cells.denied, cells.allowed, cells.held_denied, cells.held_allowed):
        f = np.bincount(bits, weights=w, minlength=1 << k).astype("int64")
        for i in range(k):
            g = f.reshape(-1, 2, 1 << i)
            g[:, 1, :] += g[:, 0, :]
        sums.append(f)
    subsets = np.arange(1 << k)
    free = (1 << k) - 1 - subsets  # patterns within the complement are those that no chosen candidate hits
    missed, wrong = sums[0][free], int(cells.allowed.sum()) - sums[1][free]
    held_missed, held_wrong = sums[2][free], int(cells.held_allowed.sum()) - sums[3][free]
    count = np.bitwise_count(subsets).astype("int64")
    cost = sum(((subsets >> i) & 1) * expr.complexity(c.tree) for i, c in enumerate(pool)) if pool else np.zeros(1, int)
    nd, na = int(cells.denied.sum()), int(cells.allowed.sum())
    # a cheap first part of the key leaves few subsets to compare by all of it
    first = missed + wrong if goal.kind == "balanced" else np.where(wrong > math.floor(goal.fpr * na), 2 * (nd + na) + wrong, np.where(nd - missed < math.ceil(goal.recall * nd), nd + na + missed, wrong))
    best = min(np.flatnonzero(first == first.min()).tolist(), key=lambda s: (goal.key((int(missed[s]), int(wrong[s])), (int(held_missed[s]), int(held_wrong[s])), nd, na, int(count[s]), int(cost[s])), s))
    return [c for i, c in enumerate(pool) if best >> i & 1]


def _branch_and_bound(cells: Cells, pool: list[Candidate], goal: Goal, most_nodes: int) -> list[Candidate]:
    masks, where = np.unique(np.stack([c.mask for c in pool]), axis=1, return_inverse=True)
    weights = [np.bincount(where.ravel(), weights=w, minlength=masks.shape[1]) for w in (cells.denied, cells.allowed, cells.held_denied, cells.held_allowed)]
    d, a, vd, va = weights
    nd, na = int(cells.denied.sum()), int(cells.allowed.sum())
    # what the candidates from the i-th on could still hit
    ahead = np.logical_or.accumulate(masks[::-1], axis=0)[::-1]
    cost = [expr.complexity(c.tree) for c in pool]

    def key(hit: np.ndarray, chosen: tuple) -> tuple:
        return goal.key((int(d.sum() - d[hit].sum()), int(a[hit].sum())), (int(vd.sum() - vd[hit].sum()), int(va[hit].sum())), nd, na, len(chosen), sum(cost[i] for i in chosen))

    best: list = [key(np.zeros(masks.shape[1], bool), ()), ()]
    nodes = 0

    def visit(i: int, hit: np.ndarray, chosen: tuple) -> None:
        nonlocal nodes
        nodes += 1
        mine = (key(hit, chosen), chosen)
        if mine[0] < best[0]:
            best[:] = mine
        if i == len(pool) or nodes > most_nodes:
            return
        reach = hit | ahead[i]
        least = goal.key((int(d.sum() - d[reach].sum()), int(a[hit].sum())), (int(vd.sum() - vd[reach].sum()), int(va[hit].sum())), nd, na, len(chosen), 0)
        if least >= best[0]:
            return
        if np.any(masks[i] & ~hit):
            visit(i + 1, hit | masks[i], (*chosen, i))
        visit(i + 1, hit, chosen)

    visit(0, np.zeros(masks.shape[1], bool), ())
    return [pool[i] for i in best[1]]


def recover_rare(plan: Plan, most_conditions: int) -> None:
    """Up to three times: candidates for what is uncovered, chosen exactly beside the plan, kept only if the plan gets better."""
    for _ in range(PASSES):
        left = plan.uncovered()
        if not left.sum():
            return
        pool = shortlist(candidates(plan.cells, left, most_conditions), RARE)
        rest = plan.cells.of(left, plan.cells.allowed)
        more = plan.chosen + exact(rest, pool, plan.goal)
        if plan.key(more) >= plan.key():
            return
        plan.chosen = more


def residual_conjunctions(plan: Plan, most: int = 3, least: int = 2, most_wrong: int = 0) -> None:
    """Conjunctions of boolean features (true or false) for denied rows that no rule hits: those that hit `least` of them and at
    most `most_wrong` allowed rows, most hits first, while the plan gets better."""
    cells = plan.cells
    flags = [(expr.leaf(f, "==", v), cells.codes[f] == int(v)) for f, k in cells.kinds.items() if k == "bool" for v in (True, False)]
    while plan.uncovered().sum() >= least:
        left, level, found = plan.uncovered(), [(-1, (), np.ones(len(cells.denied), bool))], []
        for _ in range(most):
            grown = []
            for last, parts, mask in level:
                for i in range(last + 1, len(flags)):
                    leaf, m = flags[i]
                    if any(p["feature"] == leaf["feature"] for p in parts):
                        continue
                    both = mask & m
                    d, a = int(left[both].sum()), int(cells.allowed[both].sum())
                    if d < least:
                        continue
                    tree = {"all": [*parts, leaf]} if parts else leaf
                    if a <= most_wrong:
                        found.append((-d, len(parts), expr.key(tree), Candidate(tree, both, d, a, 0.0)))
                    else:
                        grown.append((i, (*parts, leaf), both))
            level = sorted(grown, key=lambda x: -int(left[x[2]].sum()))[:256]
        better = next((c for *_, c in sorted(found, key=lambda x: x[:3]) if plan.key([*plan.chosen, c]) < plan.key()), None)
        if better is None:
            return
        plan.chosen = [*plan.chosen, better]


def generalize(plan: Plan) -> None:
    """Drops conjuncts, drops rules and what another rule subsumes, joins rules that differ in one string's value into `in`, and
    puts what several rules share in the place of them all, while the plan gets better by the rows kept for validation first."""
    cells = plan.cells
    make = lambda tree: Candidate(tree, cells.mask(tree), 0, 0, 0.0)
    some = cells.denied + cells.allowed + cells.held_denied + cells.held_allowed > 0

    def options() -> Iterator[list[Candidate]]:
        for i, c in enumerate(plan.chosen):
            yield plan.chosen[:i] + plan.chosen[i + 1 :]
            parts = expr.leaves(c.tree)
            if len(parts) < 2 or "all" not in c.tree:
                continue
            for size in range(1, len(parts)):
                for rest in itertools.combinations(parts, size):
                    wider = make(rest[0] if len(rest) == 1 else {"all": list(rest)})
                    # the wider rule stands for all that it subsumes
                    yield [o for o in plan.chosen if o is not c and np.any(o.mask & ~wider.mask & some)] + [wider]
        groups: dict[str, list[tuple[int, dict]]] = {}
        for i, c in enumerate(plan.chosen):
            for p in expr.leaves(c.tree):
                if cells.kinds[p["feature"]] == "string" and p["op"] in ("==", "in"):
                    rest = sorted(expr.key(q) for q in expr.leaves(c.tree) if q is not p)
                    groups.setdefault(p["feature"] + "|" + "|".join(rest), []).append((i, p))
        for same in groups.values():
            if len(same) > 1:
                gone = {i for i, _ in same}
                values = sorted({v for _, p in same for v in (p["value"] if isinstance(p["value"], list) else [p["value"]])})
                rest = [q for q in expr.leaves(plan.chosen[same[0][0]].tree) if q is not same[0][1]]
                joined = expr.leaf(same[0][1]["feature"], "in", values)
                yield [c for i, c in enumerate(plan.chosen) if i not in gone] + [make({"all": [*rest, joined]} if rest else joined)]

    better = True
    while better:
        better = False
        before = plan.key(order="general")
        for option in options():
            if plan.key(option, "general") < before:
                plan.chosen, better = option, True
                break


def tighten(plan: Plan, least_wrong: int = 1, keep: float = 0.5) -> None:
    """Adds one boolean condition to a rule whose own false positives it removes while it keeps half of its own hits."""
    cells = plan.cells
    flags = [(expr.leaf(f, "==", v), cells.codes[f] == int(v)) for f, k in cells.kinds.items() if k == "bool" for v in (True, False)]
    for i, c in enumerate(plan.chosen):
        others = np.logical_or.reduce([o.mask for j, o in enumerate(plan.chosen) if j != i] or [np.zeros(len(c.mask), bool)])
        own = c.mask & ~others
        wrong, right = int(cells.allowed[own].sum()), int(cells.denied[own].sum())
        if wrong < least_wrong:
            continue
        used = expr.features(c.tree)
        options = [Candidate({"all": [*expr.leaves(c.tree), leaf]}, c.mask & m, 0, 0, 0.0) for leaf, m in flags if leaf["feature"] not in used and cells.denied[own & m].sum() >= keep * right]
        best = min(options, key=lambda o: plan.key([*plan.chosen[:i], o, *plan.chosen[i + 1 :]]), default=None)
        if best and plan.key([*plan.chosen[:i], best, *plan.chosen[i + 1 :]]) < plan.key():
            plan.chosen[i] = best


def sharpen(plan: Plan, sweeps: int = 10) -> None:
    """Moves each edge of a rule to the threshold of its axis at which the plan is best, the others staying where they are, until
    no edge moves. Sums by place on the axis give all thresholds of an edge at once."""
    cells = plan.cells
    nd, na = int(cells.denied.sum()), int(cells.allowed.sum())
    weights = (cells.denied, cells.allowed, cells.held_denied, cells.held_allowed)
    totals = [int(w.sum()) for w in weights]
    for _ in range(sweeps):
        moved = False
        for i in range(len(plan.chosen)):
            for j in range(len(expr.leaves(plan.chosen[i].tree))):
                parts = expr.leaves(plan.chosen[i].tree)
                x = parts[j]
                if cells.kinds[x["feature"]] != "number" or x["op"] not in expr.ORDERED or "any" in plan.chosen[i].tree:
                    continue
                axis, code = cells.axes[x["feature"]], cells.codes[x["feature"]]
                others = np.logical_or.reduce([o.mask for k, o in enumerate(plan.chosen) if k != i] or [np.zeros(len(code), bool)])
                own = np.logical_and.reduce([cells.leaf(p) for k, p in enumerate(parts) if k != j] or [np.ones(len(code), bool)]) & ~others & (code >= 0)
                at = 2 * np.arange(len(axis)) + 1
                runs = [np.cumsum(np.bincount(code[own], weights=w[own], minlength=2 * len(axis) + 1)) for w in weights]
                base = [w[others].sum() for w in weights]
                cost = sum(expr.complexity(c.tree) for c in plan.chosen)
                options = []
                for op in (x["op"], {"<": "<=", "<=": "<", ">": ">=", ">=": ">"}[x["op"]]):
                    upto = [{"<": r[at - 1], "<=": r[at], ">=": r[-1] - r[at - 1], ">": r[-1] - r[at]}[op] + n for r, n in zip(runs, base, strict=True)]
                    for k, (hd, ha, vd, va) in enumerate(zip(*(u.astype("int64").tolist() for u in upto), strict=True)):
                        options.append((plan.goal.key((totals[0] - hd, ha), (totals[2] - vd, va), nd, na, len(plan.chosen), cost), op != x["op"], abs(k - axis.index(x["value"])), op, k))
                now = next(o[0] for o in options if not o[1] and not o[2])
                best = min(options)
                if best[0] < now:
                    leaves = [*parts[:j], expr.leaf(x["feature"], best[3], axis[best[4]]), *parts[j + 1 :]]
                    tree = leaves[0] if len(leaves) == 1 else {"all": leaves}
                    plan.chosen[i] = Candidate(tree, cells.mask(tree), 0, 0, 0.0)
                    moved = True
        if not moved:
            return


def limit_rules(cells: Cells, chosen: list[Candidate], most: int) -> list[Candidate]:
    """The most useful rules first: new denied hits, then fewer allowed hits, more hits, shorter, in order."""
    left, out, rest = cells.denied.copy(), [], list(chosen)
    while rest and len(out) < most:
        best = min(rest, key=lambda c: (-int(left[c.mask].sum()), int(cells.allowed[c.mask].sum()), -int(cells.denied[c.mask].sum()), len(expr.key(c.tree))))
        if not left[best.mask].sum():
            break
        out.append(best)
        rest.remove(best)
        left[best.mask] = 0
    return out


def merge_intervals(trees: list[dict]) -> list[dict]:
    """Rules that are one interval of one number each are joined where they touch or overlap."""
    def ends(t: dict) -> tuple | None:
        parts = expr.leaves(t)
        if len({p["feature"] for p in parts}) > 1 or "any" in t or "not" in t or not all(p["op"] in expr.ORDERED and expr.is_number(p.get("value")) for p in parts):
            return None
        low = max(((p["value"], p["op"] == ">") for p in parts if p["op"][0] == ">"), default=(-math.inf, False))
        high = min(((p["value"], p["op"] == "<=") for p in parts if p["op"][0] == "<"), default=(math.inf, True))
        return parts[0]["feature"], low, high

    found, out = {}, []
    for t in trees:
        e = ends(t)
        if e is None:
            out.append(t)
        else:
            found.setdefault(e[0], []).append(e[1:])
    for f, spans in found.items():
        merged: list[list] = []
        for low, high in sorted(spans):
            # (value, open) starts after or at (value, closed): they touch unless both ends are open
            if merged and (low[0] < merged[-1][1][0] or (low[0] == merged[-1][1][0] and (merged[-1][1][1] or not low[1]))):
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        for low, high in merged:
            parts = ([expr.leaf(f, ">" if low[1] else ">=", low[0])] if low[0] > -math.inf else []) + ([expr.leaf(f, "<=" if high[1] else "<", high[0])] if high[0] < math.inf else [])
            if parts:
                out.append(parts[0] if len(parts) == 1 else {"all": parts})
    return out


def prune(cells: Cells, trees: list[dict]) -> list[dict]:
    """Drops rules without which no cell's verdict changes."""
    kept = list(trees)
    for t in reversed(trees):
        rest = [x for x in kept if x is not t]
        if rest and np.array_equal(cells.mask(expr.union(kept)), cells.mask(expr.union(rest))):
            kept = rest
    return kept


def rules_of(cells: Cells, goal: Goal = Goal(), most_rules: int = 16, most_conditions: int = 3) -> list[dict]:
    """The whole search on one table of cells."""
    plan = Plan(cells, goal)
    greedy(plan, most_rules, most_conditions)
    pool = list({expr.signature(c.tree): c for c in [*plan.chosen, *candidates(cells, cells.denied, most_conditions)]}.values())
    option = exact(cells, pool, goal)
    if plan.key(option) < plan.key():
        plan.chosen = option
    recover_rare(plan, most_conditions)
    residual_conjunctions(plan)
    sharpen(plan)
    tighten(plan)
    generalize(plan)
    sharpen(plan)
    trees = [c.tree for c in limit_rules(cells, plan.chosen, most_rules)]
    return prune(cells, merge_intervals(trees))


def _features(cells: Cells) -> tuple[Feature, ...]:
    return tuple(Feature(c, _TYPES[k]) for c, k in cells.kinds.items())


def _gate(id: str, features: tuple[Feature, ...], trees: list[dict], pinned: tuple[Rule, ...] = ()) -> Gate:
    """Rules in order; a pinned rule wins over a learned one of its signature."""
    fixed = {expr.signature(r.when) for r in pinned}
    fresh = [t for t in trees if expr.signature(t) not in fixed]
    learned = [Rule(f"rule_{i:03d}", t, len(pinned) + i, label=expr.label(t), hint=expr.hint(t)) for i, t in enumerate(fresh)]
    return Gate(id, features, (*[Rule(**{**r.__dict__, "bit": i}) for i, r in enumerate(pinned)], *learned)).validate()


@dataclass
class Learned:
    policy: Gate | ActionPolicy | FanOut
    report: dict


def _search(df: DataFrame, columns: list[str], said: Column, goal: Goal, most_rules: int, most_conditions: int, rounds: int) -> tuple[tuple, Cells, list[dict]]:
    """(key, cells, rules): the search on cells, with axes made finer about the rules' edges until no edge moves."""
    cells = cell_table(df, columns, said)
    trees = rules_of(cells, goal, most_rules, most_conditions) if cells.denied.sum() else []
    score = lambda c, t: Plan(c, goal, [Candidate(x, c.mask(x), 0, 0, 0.0) for x in t]).key()
    best = (score(cells, trees), cells, trees)
    for _ in range(rounds if trees else 0):
        if not any(best[0][:2]):
            break
        hit = Compiler(_features(cells), "lenient").tree(expr.union(best[2]))
        more = finer(df, said, ~hit, best[1], best[2])
        if more is None:
            break
        axes, whole, keep = more
        cells = cell_table(df, columns, said, (axes, whole), keep=keep)
        trees = rules_of(cells, goal, most_rules, most_conditions)
        kept = None
        if all(_on_axes(cells, t) for t in best[2]):
            same = Plan(cells, goal, [Candidate(t, cells.mask(t), 0, 0, 0.0) for t in best[2]])
            kept = same.key()
            sharpen(same)
            trees = min(trees, [c.tree for c in same.chosen], key=lambda t: score(cells, t))
        option = (score(cells, trees), cells, trees)
        if option[0] < best[0]:
            best = option
        elif kept is not None and _widths(cells, best[2]) != _widths(best[1], best[2]):
            best = (kept, cells, best[2])  # no better yet, but the edges are closed in further
        else:
            break
    # what is missed still and can be had without a new error
    key, cells, trees = best
    for p in proposals(cells, trees) if trees and len(trees) < most_rules else []:
        if p["safe"] and len(trees) < most_rules and score(cells, [*trees, p["tree"]]) < key:
            trees = [*trees, p["tree"]]
            key = score(cells, trees)
    return key, cells, trees


def learn_gate(df: DataFrame, columns: list[str], denied: Column, id: str = "gate", goal: Goal = Goal(), most_rules: int = 16, pinned: tuple[Rule, ...] = (), most_conditions: int = 3, rounds: int = 8, pairs: bool = True) -> Learned:
    """A gate that denies what the labels deny.

    Rows are reduced to cells and the rules are sought on these. Where an axis doesn't hold all thresholds or values, those
    about each rule's edges and of missed rows are brought in and the search goes on, until no edge can be moved. Where errors
    are left, differences and ratios of two numbers that tell more than either (`interactions`) become features too, which is
    how a comparison of two columns is found. The rules are chosen by the rows that train and, among equals, by a fifth kept for
    validation; the report counts all rows.
    """
    said = F.coalesce(denied, F.lit(False))
    key, cells, trees = _search(df, columns, said, goal, most_rules, most_conditions, rounds)
    features = _features(cells)
    if pairs and trees and any(key[:2]) and sum(k == "number" for k in cells.kinds.values()) > 1:
        found = interactions(df, columns, said)
        if found:
            wide = df.withColumns({f.name: derive(f.derived["kind"], F.col(f"`{f.derived['left']}`"), F.col(f"`{f.derived['right']}`")) for f in found})
            option = _search(wide, [*columns, *[f.name for f in found]], said, goal, most_rules, most_conditions, rounds)
            if option[0] < key:
                key, cells, trees = option
                used = {f for t in trees for f in expr.features(t)}
                features = tuple(f for f in _features(cells) if f.name in columns) + tuple(f for f in found if f.name in used)
    gate = _gate(id, features, trees, pinned)
    hit = cells.mask(expr.union([r.when for r in gate.rules if _on_axes(cells, r.when)])) if gate.rules else np.zeros(len(cells.denied), bool)
    d, a = cells.denied + cells.held_denied, cells.allowed + cells.held_allowed
    nd, na = int(d.sum()), int(a.sum())
    tp, fp = int(d[hit].sum()), int(a[hit].sum())
    report = {"rows": nd + na, "denied": nd, "recall": tp / nd if nd else 0.0, "fpr": fp / na if na else 0.0, "parity": (tp + na - fp) / max(nd + na, 1), "rules": len(gate.rules), "held": int(cells.held_denied.sum() + cells.held_allowed.sum())}
    report["advice"] = recommend(report)
    return Learned(gate, report)


def _on_axes(cells: Cells, tree: dict) -> bool:
    return all("value" in x and x["feature"] in cells.axes and all(v in cells.axes[x["feature"]] for v in (x["value"] if isinstance(x["value"], list) else [x["value"]])) for x in expr.leaves(tree))


def _widths(cells: Cells, trees: list[dict]) -> list:
    """What lies next to each edge of a number on its axis."""
    out = []
    for x in (x for t in trees for x in expr.leaves(t)):
        if cells.kinds[x["feature"]] == "number":
            axis = cells.axes[x["feature"]]
            i = axis.index(x["value"])
            out.append((x["feature"], axis[max(i - 1, 0)], x["value"], axis[min(i + 1, len(axis) - 1)]))
    return out


def recommend(report: dict) -> str | None:
    """A rare class of which much is missed calls for the goal `recall`."""
    rare = report["denied"] <= 0.15 * report["rows"]
    return "recall" if rare and report["recall"] < 0.8 and report["denied"] else None


def learn_actions(df: DataFrame, columns: list[str], action: str, default: str | None = None, id: str = "actions", mode: str = "first_match", most_rules: int | None = None) -> Learned:
    """Sequential covering: the rarest action first; rows that its rules cover no longer train later ones. The default is the
    commonest action and has no rules."""
    counts = {r["a"]: r["n"] for r in df.groupBy(F.col(action).alias("a")).agg(F.count("*").alias("n")).filter("a is not null").collect()}
    default = default or max(sorted(counts), key=lambda a: counts[a])
    total = sum(counts.values())
    budget = most_rules or min(256, max(16, 8 * math.ceil(math.sqrt(len(counts)))))
    rest, rules, features = df, [], ()
    for a in sorted((a for a in counts if a != default), key=lambda a: (counts[a], a)):
        share = max(1, round(budget * counts[a] / max(total, 1)))
        got = learn_gate(rest, columns, F.col(action) == a, f"{id}_{a}", most_rules=share).policy
        features = got.features
        base = len(rules)
        weights = _weights(rest, got, F.col(action) == a)
        rules += [Rule(f"{a}_{i:03d}", r.when, base + i, a, base + i, max(1, weights[i])) for i, r in enumerate(got.rules)]
        if got.rules:
            c = Compiler(got.features, "lenient")
            rest = rest.filter(~c.tree(expr.union([r.when for r in got.rules])))
    if not features:
        features = _features(cell_table(df.limit(0), columns, F.lit(False)))
    return Learned(ActionPolicy(id, features, tuple(rules), default, mode=mode).validate(), {"counts": counts, "budget": budget, "rules": len(rules)})


def _weights(df: DataFrame, gate: Gate, wanted: Column) -> list[int]:
    if not gate.rules:
        return []
    c = Compiler(gate.features, "lenient")
    row = df.agg(*[F.count_if(c.tree(r.when) & wanted).alias(str(i)) for i, r in enumerate(gate.rules)]).first()
    return [int(x) for x in row]


def learn_fan_out(df: DataFrame, columns: list[str], actions: str, id: str = "fan_out") -> Learned:
    """A gate for each action of the array column, against all other rows."""
    names = [r[0] for r in df.select(F.explode(actions).alias("a")).distinct().orderBy("a").collect()]
    gates, reports = [], {}
    for a in names:
        got = learn_gate(df, columns, F.array_contains(F.col(actions), a), f"{id}_{a}")
        gates.append((a, got.policy))
        reports[a] = got.report
    return Learned(FanOut(id, tuple(gates)).validate(), reports)


def learn_targets(df: DataFrame, columns: list[str], targets: list[str]) -> tuple[dict[str, Learned], dict[str, str]]:
    """A gate for each boolean target, and why others were skipped."""
    counts = df.agg(*[F.count_if(F.col(t)).alias(t) for t in targets], F.count("*").alias("_n")).first()
    skipped = {t: "one class only" for t in targets if counts[t] in (0, counts["_n"])}
    return {t: learn_gate(df, columns, F.col(t), t) for t in targets if t not in skipped}, skipped


def interactions(df: DataFrame, columns: list[str], denied: Column, most: int = 8, sources: int = 6) -> list[Feature]:
    """Differences and ratios of pairs of numbers whose best threshold has more signal than either side's. Two histograms, of the
    columns and of all pairs, whatever their number."""
    kinds = kinds_of(df, columns)
    numbers = [c for c in columns if kinds[c] == "number"]
    said = F.coalesce(denied, F.lit(False))

    def best(table: DataFrame, names: list[str], label: Column) -> dict[str, float]:
        found = threshold_coverage(table, names, label).filter("op <> '=='").groupBy("field").agg(F.max("signal").alias("s"))
        return {n: 0.0 for n in names} | {r["field"]: r["s"] for r in found.collect()}

    if len(numbers) < 2:
        return []
    scores = best(df, numbers, said)
    top = sorted(scores, key=lambda c: (-scores[c], c))[:sources]
    # of a difference one order of the two says it all
    names = {f"{a}__{'minus' if k == 'difference' else 'over'}__{b}": (k, a, b) for a in top for b in top for k in ("difference", "ratio") if a != b and (k == "ratio" or a < b)}
    wide = df.select(said.alias("_y"), *[derive(k, F.col(f"`{a}`"), F.col(f"`{b}`")).alias(n) for n, (k, a, b) in names.items()])
    signal = best(wide, list(names), F.col("_y"))
    found = [(-signal[n], n, Feature(n, "float", derived={"kind": k, "left": a, "right": b})) for n, (k, a, b) in names.items() if signal[n] > max(scores[a], scores[b])]
    return [f for _, _, f in sorted(found, key=lambda x: x[:2])[:most]]


def proposals(cells: Cells, trees: list[dict], most: int = 16) -> list[dict]:
    """Single predicates that would mend mismatches: fixed, introduced, safe (fixes two or more and introduces none)."""
    hit = cells.mask(expr.union(trees)) if trees else np.zeros(len(cells.denied), bool)
    left, clean = np.where(hit, 0, cells.denied), np.where(hit, 0, cells.allowed)
    if not left.sum():
        return []
    rest = cells.of(left, clean)
    rows = [{"tree": c.tree, "fixed": c.denied, "introduced": c.allowed, "safe": c.denied >= 2 and c.allowed == 0} for c in candidates(rest, left, 2)]
    return sorted(rows, key=lambda r: (not r["safe"], r["introduced"] - r["fixed"], r["introduced"], expr.signature(r["tree"])))[:most]


def vote_aware(df: DataFrame, policy: ActionPolicy, action: str, most_patterns: int = 100_000) -> ActionPolicy:
    """Drops rules while the weighted vote agrees with no fewer training rows. Rows are first reduced to patterns."""
    c = Compiler(policy.features, "lenient")
    rules = policy.ordered()
    words = []
    for at in range(0, len(rules), 62):
        bits = F.lit(0).cast("long")
        for i, r in enumerate(rules[at : at + 62]):
            bits = bits.bitwiseOR(F.when(c.tree(r.when), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(bits)
    found = df.groupBy(F.array(*words).alias("b"), F.col(action).alias("a")).count().limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of rules")
    rows = [{"b": sum(w << (62 * k) for k, w in enumerate(r["b"])), "a": r["a"], "count": r["count"]} for r in found]

    def agreed(kept: list[int]) -> int:
        total = 0
        for r in rows:
            votes: dict[str, int] = {}
            for i in kept:
                if r["b"] >> i & 1:
                    votes[rules[i].action] = votes.get(rules[i].action, 0) + max(1, rules[i].weight)
            said = max(votes, key=lambda a: votes[a]) if votes else policy.no_match_action or policy.default_action
            total += r["count"] * (said == r["a"])
        return total

    kept, best = list(range(len(rules))), -1
    best = agreed(kept)
    for i in reversed(range(len(rules))):
        option = [k for k in kept if k != i]
        if (n := agreed(option)) >= best:
            kept, best = option, n
    return ActionPolicy(policy.id, policy.features, tuple(rules[i] for i in kept), policy.default_action, policy.no_match_action, "weighted_vote").validate()


def select_phrases(hits: np.ndarray, negatives: np.ndarray, most: int = 16) -> list[int]:
    """Of phrases (columns of `hits`: which positive texts they match; `negatives`: how many others), a subset with the fewest
    missed texts, then the fewest negatives, then the fewest phrases: exact over the `most` best, greedy beyond."""
    n = hits.shape[1]
    order = sorted(range(n), key=lambda i: (negatives[i] - hits[:, i].sum(), negatives[i], i))[:most]
    some = hits[hits[:, order].any(axis=1)][:, order] if len(hits) else hits[:, order]
    bits = (some.astype("int64") << np.arange(len(order))).sum(axis=1)
    f = np.bincount(bits, minlength=1 << len(order)).astype("int64")
    for i in range(len(order)):
        g = f.reshape(-1, 2, 1 << i)
        g[:, 1, :] += g[:, 0, :]
    subsets = np.arange(1 << len(order))
    missed = f[(1 << len(order)) - 1 - subsets]
    wrong = sum(((subsets >> i) & 1) * int(negatives[p]) for i, p in enumerate(order)) if order else np.zeros(1, int)
    best = int(np.lexsort((subsets, np.bitwise_count(subsets), wrong, missed))[0])
    chosen = [order[i] for i in range(len(order)) if best >> i & 1]
    left = ~hits[:, chosen].astype(bool).any(axis=1)
    rest = [i for i in range(n) if i not in set(order)]
    while rest and left.any():
        new = {i: int(hits[left, i].sum()) for i in rest}
        i = min(rest, key=lambda i: (-new[i], negatives[i], i))
        if not new[i]:
            break
        chosen.append(i)
        rest.remove(i)
        left &= ~hits[:, i].astype(bool)
    return sorted(chosen)
