"""What a learner needs of the data: coverage by threshold, atoms and their signal, and the table of cells.

All that learning looks at is which comparisons hold for a row and its label. One aggregate reduces any number of rows to
weighted cells (each feature's place among its thresholds or values); everything after that is arithmetic on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from juncture.functions import grams
from juncture.operators.audit import unpivot, unpivot_numbers
from juncture.plans import expr

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Thresholds or values of one feature looked at together: with more, so many quantiles (with the least and the greatest) or the
#: values of most signal come first, and `finer` brings in the others where a rule has its edge or rows are still missed.
MOST_THRESHOLDS, MOST_CELLS = 256, 200_000
#: Rows of either class from which a fifth is kept for validation.
LEAST_OF_CLASS = 20
EQ_VALUES, EQ_SUPPORT, EQ_SHARE = 20, 3, 0.001
ATOMS, LEVEL, TOTAL = 128, 256, 2048
#: Phrases that other texts are searched for in a first pass, and in any pass at most.
FIRST_PHRASES, MOST_PHRASES = 16_000, 200_000


def gtest(d: Column, a: Column, nd: Column, na: Column) -> Column:
    """2 * sum(O * ln(O / E)) of the table (hit or not) x (denied or not); 0 unless precision exceeds the base rate."""
    n, hit = nd + na, d + a
    cells = [(d, hit, nd), (a, hit, na), (nd - d, n - hit, nd), (na - a, n - hit, na)]
    term = lambda o, r, c: F.when(o > 0, o * F.ln(o.cast("double") * n / (r * c))).otherwise(0.0)
    total = sum((term(*x) for x in cells[1:]), term(*cells[0]))
    return F.when((hit > 0) & (d * n > nd * hit), 2 * total).otherwise(0.0)


def threshold_coverage(df: DataFrame, columns: list[str], denied: Column, ranges: int = 64) -> DataFrame:
    """field, threshold, op, denied_hits, allowed_hits, signal: for each threshold (denied values to three decimals) and
    comparison, the rows that satisfy it. One histogram and running sums instead of a scan for each threshold.

    A field's values are divided into about `ranges` ranges; sums run within a range, and what lies before it is added from a
    small table of sums, so no task holds a whole field.
    """
    long = unpivot_numbers(df, columns, denied.alias("_d")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    hist = long.groupBy("field", "v").agg(F.count_if("_d").alias("d"), F.count_if(~F.col("_d")).alias("a"))
    at = hist.filter("d > 0").select("field", (F.round(F.col("v") * 1000) / 1000).alias("v")).distinct()
    axis = hist.select("field", "v", "d", "a", F.lit(False).alias("t")).unionByName(at.select("field", "v", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("a"), F.lit(True).alias("t")))
    cuts = {r["field"]: r["q"] for r in axis.groupBy("field").agg(F.percentile_approx("v", [(i + 1) / ranges for i in range(ranges - 1)], 1000).alias("q")).collect()}
    which = F.lit(0)
    for c, q in cuts.items():
        inner = F.array(*[F.lit(x) for x in sorted(set(q or ()))])
        which = F.when(F.col("field") == c, F.size(F.filter(inner, lambda x: x <= F.col("v")))).otherwise(which)
    axis = axis.withColumn("r", which).groupBy("field", "r", "v").agg(F.sum("d").alias("d"), F.sum("a").alias("a"), F.max("t").alias("t"))
    sums = axis.groupBy("field", "r").agg(F.sum("d").alias("rd"), F.sum("a").alias("ra"))
    whole, before = Window.partitionBy("field"), Window.partitionBy("field").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("field", "r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c[1]}") for c in ("rd", "ra")], F.sum("rd").over(whole).alias("nd"), F.sum("ra").over(whole).alias("na"))
    inside = Window.partitionBy("field", "r").orderBy("v")
    summed = axis.select("field", "r", "v", "t", "d", "a", F.sum("d").over(inside).alias("sd"), F.sum("a").over(inside).alias("sa")).filter("t")
    run = summed.join(F.broadcast(offsets), ["field", "r"]).withColumns({"cd": F.col("sd") + F.col("bd"), "ca": F.col("sa") + F.col("ba")})
    ops = {"<": ("cd - d", "ca - a"), "<=": ("cd", "ca"), "==": ("d", "a"), ">=": ("nd - cd + d", "na - ca + a"), ">": ("nd - cd", "na - ca")}
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.expr(d).alias("denied_hits"), F.expr(a).alias("allowed_hits")) for o, (d, a) in ops.items()]))
    rows = run.select("field", F.col("v").alias("threshold"), "nd", "na", each.alias("x")).select("field", "threshold", "nd", "na", "x.*")
    return rows.withColumn("signal", gtest(F.col("denied_hits"), F.col("allowed_hits"), F.col("nd"), F.col("na"))).drop("nd", "na")


def top_atoms(coverage: DataFrame, k: int = ATOMS) -> DataFrame:
    """The k best of `threshold_coverage`: signal, then fewer allowed hits, more denied hits, and by name."""
    return coverage.filter("signal > 0").orderBy(F.desc("signal"), "allowed_hits", F.desc("denied_hits"), "field", "threshold", "op").limit(k)


def patterns(df: DataFrame, trees: list[Column], denied: Column) -> DataFrame:
    """bits (which predicates hold, at most 62), n_denied, n_allowed: all that a choice among them depends on."""
    bits = F.lit(0).cast("long")
    for i, t in enumerate(trees):
        bits = bits.bitwiseOR(F.when(t, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.groupBy(bits.alias("bits")).agg(F.count_if(denied).alias("n_denied"), F.count_if(~denied).alias("n_allowed"))


@dataclass
class Cells:
    """Weighted cells on the driver. kinds: number, bool, string; axes: thresholds or values; codes: each cell's place.

    A number's code is 2 * i + 1 at its i-th threshold and 2 * i below it; -1 is null. denied and allowed count the rows that
    train; held_denied and held_allowed those kept for validation (none if a class has too few rows). `whole`: the features
    of which every threshold or value is on the axis.
    """

    kinds: dict[str, str]
    axes: dict[str, list]
    codes: dict[str, np.ndarray]
    denied: np.ndarray
    allowed: np.ndarray
    held_denied: np.ndarray
    held_allowed: np.ndarray
    whole: frozenset = frozenset()

    def of(self, denied: np.ndarray, allowed: np.ndarray) -> Cells:
        """The same cells with other training weights."""
        return Cells(self.kinds, self.axes, self.codes, denied, allowed, np.zeros_like(denied), np.zeros_like(allowed), self.whole)

    def leaf(self, x: dict) -> np.ndarray:
        f, op, value = x["feature"], x["op"], x["value"]
        code = self.codes[f]
        if self.kinds[f] == "number":
            at = 2 * self.axes[f].index(value) + 1
            hit = {"<": code < at, "<=": code <= at, "==": code == at, ">=": code >= at, ">": code > at}[op]
        else:
            wanted = [self.axes[f].index(v) for v in (value if isinstance(value, list) else [value])]
            hit = np.isin(code, wanted)
        return hit & (code >= 0)

    def mask(self, tree: dict) -> np.ndarray:
        if "all" in tree:
            return np.logical_and.reduce([self.mask(c) for c in tree["all"]])
        if "any" in tree:
            return np.logical_or.reduce([self.mask(c) for c in tree["any"]])
        return self.leaf(tree)


def kinds_of(df: DataFrame, columns: list[str]) -> dict[str, str]:
    types = dict(df.dtypes)
    return {c: "bool" if types[c] == "boolean" else "number" if types[c].startswith(NUMBERS) else "string" for c in columns}


def first_axes(df: DataFrame, kinds: dict[str, str], denied: Column, most: int = MOST_THRESHOLDS) -> tuple[dict[str, list], frozenset]:
    """(axes, the features of which they are whole)."""
    numbers, strings = ([c for c, k in kinds.items() if k == kind] for kind in ("number", "string"))
    axes: dict[str, list] = {c: [False, True] for c, k in kinds.items() if k == "bool"}
    found, whole = _number_axes(df.filter(denied), {c: (c, None, None) for c in numbers}, most)
    values, all_values = _string_axes(df, strings, denied, most)
    return axes | found | values, frozenset([*axes, *whole, *all_values])


def cell_table(df: DataFrame, columns: list[str], denied: Column, axes: tuple[dict[str, list], frozenset] | None = None, most_cells: int = MOST_CELLS, keep: dict[str, set] | None = None) -> Cells:
    """The cells of all rows. Only counts and axes come to the driver, at most `most_cells` rows of them: with more, the
    axes of numbers are halved (but for the thresholds in `keep`) until they fit, which makes thresholds coarser and leaves no
    row out. A fifth of the rows, chosen by a hash of features and label, is kept for validation."""
    kinds = kinds_of(df, columns)
    df = df.withColumn("_denied", F.coalesce(denied, F.lit(False)))
    numbers = [c for c in columns if kinds[c] == "number"]
    axes, whole = axes or first_axes(df, kinds, F.col("_denied"))
    keep = keep or {}
    held = F.pmod(F.xxhash64(F.col("_denied"), *[F.col(f"`{c}`").cast("string") for c in columns]), F.lit(5)) == 0
    while True:
        coded = df.select("_denied", held.alias("_held"), *[F.col(f"`{c}`").cast("double").alias(f"n{i}") for i, c in enumerate(numbers)], *[F.col(f"`{c}`") for c in columns if kinds[c] != "number"])
        used = [(i, c) for i, c in enumerate(numbers) if axes[c]]
        if used:
            coded = Bucketizer(splitsArray=[[-float("inf"), *axes[c], float("inf")] for _, c in used], inputCols=[f"n{i}" for i, _ in used], outputCols=[f"b{i}" for i, _ in used], handleInvalid="keep").transform(coded)
        codes = []
        for i, c in enumerate(numbers):
            if not axes[c]:
                codes.append(F.when(F.col(f"n{i}").isNull(), -1).otherwise(0).alias(c))
                continue
            b = F.col(f"b{i}").cast("int")
            at = F.get(F.array(*map(F.lit, axes[c])), b - 1)
            codes.append(F.when(F.col(f"n{i}").isNull() | F.isnan(f"n{i}"), -1).when(F.col(f"n{i}") == at, 2 * b - 1).otherwise(2 * b).alias(c))
        for c in columns:
            if kinds[c] == "bool":
                codes.append(F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(-1)).alias(c))
            elif kinds[c] == "string":
                place = F.array_position(F.array(*map(F.lit, axes[c])), F.col(f"`{c}`")).cast("int") - 1 if axes[c] else F.lit(-1)
                codes.append(F.coalesce(place, F.lit(-1)).alias(c))
        weights = [F.count_if((F.col("_denied") if d else ~F.col("_denied")) & (F.col("_held") if v else ~F.col("_held"))).alias(n) for n, d, v in (("_d", 1, 0), ("_a", 0, 0), ("_vd", 1, 1), ("_va", 0, 1))]
        cells = coded.select("_denied", "_held", *codes).groupBy(*[f"`{c}`" for c in columns]).agg(*weights)
        got = cells.limit(most_cells + 1).toPandas()
        if len(got) <= most_cells:
            break
        longest = max(len(axes[c]) for c in numbers) if numbers else 0
        shorter = {c: [t for i, t in enumerate(axes[c]) if i % 2 == 0 or t in keep.get(c, ())] for c in numbers if len(axes[c]) > max(1, longest // 2)}
        if all(len(v) == len(axes[c]) for c, v in shorter.items()):
            raise ValueError(f"more than {most_cells} cells; give fewer features")
        axes, whole = axes | shorter, whole - set(shorter)
    got = got.sort_values(columns, kind="stable")
    d, a, vd, va = (got[c].to_numpy("int64") for c in ("_d", "_a", "_vd", "_va"))
    if min(d.sum() + vd.sum(), a.sum() + va.sum()) < LEAST_OF_CLASS or not min(d.sum(), a.sum(), vd.sum(), va.sum()):
        d, a, vd, va = d + vd, a + va, np.zeros_like(d), np.zeros_like(a)
    return Cells(kinds, axes, {c: got[c].to_numpy("int64") for c in columns}, d, a, vd, va, whole)


def _thousandth(c: str) -> Column:
    return F.round(F.col(f"`{c}`").cast("double") * 1000) / 1000


def _number_axes(denied: DataFrame, spans: dict[str, tuple], most: int) -> tuple[dict[str, list], set]:
    """For each name the thresholds of (column, above, below), both ends open or None: all of them if `most` suffice, else so
    many quantiles with the least and the greatest; and the names of which they are all. Two jobs, whatever the number of names."""
    if not spans:
        return {}, set()
    names = list(spans)
    inside = []
    for c, low, high in spans.values():
        v = _thousandth(c)
        ok = ~F.isnan(v)
        for bound, test in ((low, v > low if low is not None else None), (high, v < high if high is not None else None)):
            ok = ok if bound is None else ok & test
        inside.append(F.when(ok, v))
    shares = [(i + 1) / (most + 1) for i in range(most)]
    aggregates = []
    for i, v in enumerate(inside):
        aggregates += [F.approx_count_distinct(v, 0.02).alias(f"n{i}"), F.percentile_approx(v, shares, 10_000).alias(f"q{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    row = denied.agg(*aggregates).first()
    out = {n: sorted({*(row[f"q{i}"] or ()), *(x for x in (row[f"l{i}"], row[f"h{i}"]) if x is not None)}) for i, n in enumerate(names)}
    few = [i for i in range(len(names)) if row[f"n{i}"] <= most]
    if few:
        sets = denied.agg(*[F.collect_set(inside[i]).alias(f"s{i}") for i in few]).first()
        out |= {names[i]: sorted(sets[f"s{i}"]) for i in few}
    return out, {names[i] for i in few}


def _string_axes(df: DataFrame, columns: list[str], denied: Column, most: int) -> tuple[dict[str, list], set]:
    """The values of denied rows, or the `most` with most signal of them; and the columns of which they are all."""
    if not columns:
        return {}, set()
    counts = unpivot(df, columns, denied.alias("_d")).filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count_if("_d").alias("d"), F.count_if(~F.col("_d")).alias("a"))
    totals = counts.groupBy("field").agg(F.sum("d").alias("nd"), F.sum("a").alias("na"))
    scored = counts.filter("d > 0").join(F.broadcast(totals), "field").withColumn("signal", gtest(F.col("d"), F.col("a"), F.col("nd"), F.col("na")))
    nth = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("signal"), F.desc("d"), "value"))
    out: dict[str, list] = {c: [] for c in columns}
    for r in scored.withColumn("nth", nth).filter(F.col("nth") <= most + 1).collect():
        out[r["field"]].append((r["nth"], r["value"]))
    return {c: sorted(v for n, v in x if n <= most) for c, x in out.items()}, {c for c, x in out.items() if len(x) <= most}


def finer(df: DataFrame, denied: Column, missed: Column, cells: Cells, trees: list[dict], most: int = MOST_THRESHOLDS) -> tuple[dict[str, list], frozenset, dict[str, set]] | None:
    """(axes, whole, the thresholds to keep) with every threshold that a rule uses closed in: those between its neighbours on
    the axis come in, and those of denied rows that no rule hits; of strings the values of such rows. None if nothing is new.

    `most` at a time: an edge among n different values is found exactly in about log(n) / log(most) rounds.
    """
    open_ = [c for c, k in cells.kinds.items() if k != "bool" and c not in cells.whole]
    numbers, strings = [c for c in open_ if cells.kinds[c] == "number"], [c for c in open_ if cells.kinds[c] == "string"]
    used = {c: {x["value"] for t in trees for x in expr.leaves(t) if x["feature"] == c and "value" in x} for c in numbers}
    spans, ends = {}, {c: set() for c in numbers}
    for c in numbers:
        axis = cells.axes[c]
        for t in sorted(used[c]):
            i = axis.index(t)
            for low, high in ((axis[i - 1] if i else None, t), (t, axis[i + 1] if i + 1 < len(axis) else None)):
                spans[f"{c}|{low}|{high}"] = (c, low, high)
                ends[c] |= {x for x in (low, high) if x is not None}
    new, _ = _number_axes(df.filter(denied), spans, most)
    missing, _ = _number_axes(df.filter(denied & missed), {c: (c, None, None) for c in numbers}, 64)
    axes, keep = dict(cells.axes), {}
    for c in numbers:
        inner = {t for n, v in new.items() if spans[n][0] == c for t in v}
        thin = cells.axes[c][:: max(1, len(cells.axes[c]) // 64)]
        keep[c] = used[c] | ends[c] | inner
        axes[c] = sorted({*thin, *keep[c], *missing.get(c, ())})
    if strings:
        values, _ = _string_axes(df.filter(missed | ~denied), strings, denied, most)
        said = {c: {v for t in trees for x in expr.leaves(t) if x["feature"] == c for v in (x["value"] if isinstance(x["value"], list) else [x["value"]])} for c in strings}
        axes |= {c: sorted({*said[c], *values[c]}) for c in strings}
    if all(set(axes[c]) <= set(cells.axes[c]) for c in open_):
        return None
    return axes, cells.whole, keep


@dataclass
class Candidate:
    """A predicate with the cells that it holds for, and what it hits of what is left."""

    tree: dict
    mask: np.ndarray
    denied: int
    allowed: int
    signal: float

    @property
    def order(self) -> tuple:
        bucket = int(np.log(max(self.signal, 1e-9)) / np.log(1.05))
        cost = expr.complexity(self.tree)
        return (-bucket, cost, -(self.denied - self.allowed), self.allowed, -self.denied, expr.memorization(self.tree, self.denied), expr.signature(self.tree))


def _signal(d: np.ndarray, a: np.ndarray, nd: int, na: int) -> np.ndarray:
    d, a = np.asarray(d, float), np.asarray(a, float)
    n, hit = nd + na, d + a
    out = np.zeros(np.shape(d))
    with np.errstate(divide="ignore", invalid="ignore"):
        for o, r, c in ((d, hit, nd), (a, hit, na), (nd - d, n - hit, nd), (na - a, n - hit, na)):
            out = out + np.where(o > 0, o * np.log(o * n / (r * c)), 0.0)
    return np.where((hit > 0) & (d * n > nd * hit), 2 * out, 0.0)


def atoms(cells: Cells, left: np.ndarray, k: int = ATOMS) -> list[Candidate]:
    """The k best single comparisons against the denied rows that are `left` (a weight for each cell)."""
    nd, na = int(left.sum()), int(cells.allowed.sum())
    floor = max(EQ_SUPPORT, EQ_SHARE * (nd + na))
    found: list[tuple] = []
    for f, kind in cells.kinds.items():
        code, axis = cells.codes[f], cells.axes[f]
        good = code >= 0
        width = 2 * len(axis) + 1 if kind == "number" else len(axis)
        if not width or not axis:
            continue
        d, a = (np.bincount(code[good], weights=w[good], minlength=width)[:width] for w in (left, cells.allowed))
        if kind == "number":
            at = 2 * np.arange(len(axis)) + 1
            cd, ca = np.cumsum(d), np.cumsum(a)
            options = {"<": (cd[at - 1], ca[at - 1]), "<=": (cd[at], ca[at]), ">=": (cd[-1] - cd[at - 1], ca[-1] - ca[at - 1]), ">": (cd[-1] - cd[at], ca[-1] - ca[at])}
            if len(axis) <= EQ_VALUES:
                options["=="] = np.where(d[at] >= floor, d[at], 0), a[at]
        else:
            options = {"==": (d, a)}
        for op, (hd, ha) in options.items():
            for i, s in enumerate(_signal(hd, ha, nd, na)):
                if s > 0:
                    found.append((expr.leaf(f, op, axis[i]), int(hd[i]), int(ha[i]), float(s)))
    made = sorted((Candidate(t, np.empty(0), d, a, s) for t, d, a, s in found), key=lambda c: c.order)[:k]
    for c in made:
        c.mask = cells.leaf(c.tree)
    return made


def conjunctions(cells: Cells, left: np.ndarray, singles: list[Candidate], most: int = 3, least: int = 2) -> list[Candidate]:
    """Conjunctions of up to `most` atoms of unlike features or directions, level by level; each must hit `least` denied rows
    that are left, and fewer allowed rows than without its last atom."""
    nd, na = int(left.sum()), int(cells.allowed.sum())
    place = {expr.key(c.tree): i for i, c in enumerate(singles)}
    level, out = singles[:LEVEL], []
    for _ in range(most - 1):
        grown: dict[str, Candidate] = {}
        for c in level:
            parts = expr.leaves(c.tree)
            start = max(place[expr.key(p)] for p in parts) + 1
            for s in singles[start:]:
                if any(p["feature"] == s.tree["feature"] and p["op"][0] == s.tree["op"][0] for p in parts):
                    continue
                mask = c.mask & s.mask
                d, a = int(left[mask].sum()), int(cells.allowed[mask].sum())
                if d < least or a >= c.allowed:
                    continue
                signal = float(_signal(d, a, nd, na))
                if signal > 0:
                    tree = {"all": [*parts, s.tree]}
                    grown[expr.signature(tree)] = Candidate(tree, mask, d, a, signal)
        level = sorted(grown.values(), key=lambda c: c.order)[:LEVEL]
        out += level
    return sorted(out, key=lambda c: c.order)[:TOTAL]


def _classed(df: DataFrame, text: Column, positive: Column) -> DataFrame:
    return df.select(F.coalesce(positive, F.lit(False)).alias("positive"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))


def phrase_counts(df: DataFrame, text: Column, positive: Column, low: int = 2, high: int = 4) -> DataFrame:
    """phrase, pos, neg: in how many positive and other texts each n-gram of words occurs."""
    return grams.counted(_classed(df, text, positive), low, high)


def rank_phrases(counts: DataFrame, k: int, least: int = 2) -> DataFrame:
    """The k best phrases: (pos - neg), fewer neg, more pos, shorter, by text."""
    return counts.filter(F.col("pos") >= least).orderBy(F.desc(F.col("pos") - F.col("neg")), "neg", F.desc("pos"), F.length("phrase"), "phrase").limit(k)


def best_phrases(df: DataFrame, text: Column, positive: Column, k: int, least: int = 2, low: int = 2, high: int = 4, first: int = FIRST_PHRASES, most: int = MOST_PHRASES) -> DataFrame:
    """`rank_phrases` of `phrase_counts`, without counting the n-grams of other texts that cannot be among the k best.

    Every n-gram of the positive texts is counted. The other texts are searched for the `first` of them by pos, which gives a
    k-th best (pos - neg); an n-gram of a smaller pos cannot reach that. While some that were not searched for can, eight times as
    many are, of those that can; if they are still more than `most`, everything is counted.
    """
    rows = _classed(df, text, positive)
    ours = grams.counted(rows.filter("positive"), low, high).select("phrase", "pos")

    def with_neg(chosen: list) -> list[tuple[str, int, int]]:
        neg = {r["id"]: r["texts"] for r in grams.occurring(rows.filter("not positive"), [r["phrase"] for r in chosen]).collect()}
        return [(r["phrase"], r["pos"], neg.get(i, 0)) for i, r in enumerate(chosen)]

    n, bound = max(first, k), least
    while True:
        # what follows the limit keeps the merge of all tasks' best away from the driver
        chosen = ours.filter(F.col("pos") >= max(bound, least)).orderBy(F.desc("pos")).limit(n + 1).filter("pos > 0").collect()
        counts = with_neg(chosen)
        if len(chosen) <= n:
            break
        bound = sorted((pos - neg for _, pos, neg in counts), reverse=True)[k - 1]
        if bound > min(r["pos"] for r in chosen):
            break
        if n >= most:
            return rank_phrases(phrase_counts(df, text, positive, low, high), k, least)
        n = min(8 * n, most)
    return rank_phrases(df.sparkSession.createDataFrame(counts, "phrase string, pos long, neg long"), k, least)
