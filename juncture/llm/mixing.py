"""Mixing to target weights by soft membership, in DataFrame operations alone.

A Bernoulli naive Bayes classifier, counted from a bounded sample of labelled documents, gives each document posteriors over
domains. Nonnegative document rates are then fitted by projected gradient descent on the weighted squares of (expected
tokens of a domain - its target): a step needs sums over all documents for each domain and pair of domains, and nothing else leaves the
executors. Rates start at 1 and move about as little as the targets allow.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import bounded_sample, cut, one_text_each, stored, uniform
from juncture.llm.decontaminate import _lead, _pieces

#: Runs of ASCII signs; what lies between them.
_BETWEEN = r"[^!-/:-@\[-`{-~]+"


def label_domain() -> Column:
    """The domain of a row of `labels`: toxic, junk (quality 0) or clean; null if neither is known."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """(*keep, _text, _w, tokens, _r): the words of each text, their number, and how often they repeat (`#r` and a twentieth)."""
    pieces = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_w", _pieces(F.col("_text")))
    last = F.get("_w", F.size("_w") - 1)
    tokens = F.size("_w") - _lead(F.col("_w")) - ((F.size("_w") > 1) & (last == "")).cast("int")
    sized = pieces.withColumn("tokens", tokens.cast("long"))
    # an empty piece, at either end, is no word
    unlike = F.size(F.array_distinct("_w")) - F.array_contains("_w", "").cast("int")
    return sized.withColumn("_r", F.when(F.col("tokens") >= 20, F.concat(F.lit("#r"), F.floor(unlike * 20 / F.col("tokens")).cast("string"))).otherwise("#r"))


def terms(docs: DataFrame, *keep: str, known: list[str] | None = None) -> DataFrame:
    """(*keep, tokens, term): the distinct words of each text, its distinct runs of signs, how often words repeat, and one `#doc`
    for each row; with `known` none but these, picked out of the word array before it is unfolded."""
    words = _words(docs, *keep)
    signs = F.split("_text", _BETWEEN)
    if known is None:
        found = F.concat(F.array_distinct("_w"), F.array_distinct(signs))
    else:
        listed = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
        found = F.concat(F.array_intersect("_w", listed), F.array_intersect(signs, listed))
    return words.select(*keep, "tokens", F.explode(F.concat(F.array(F.lit("#doc"), F.col("_r")), found)).alias("term")).filter("term <> ''")


def train(docs: DataFrame, labels: DataFrame, domains: list[str], a_domain: int = 1500, most_terms: int = 400, least_docs: int = 6, least_lift: float = 2.0, least_chi: float = 20.0) -> DataFrame:
    """(term, w): for each domain, what a term adds to its log odds; the row `#doc` holds what all documents start with.

    At most `a_domain` labelled documents of each domain are read; priors are counted over all labelled rows. The
    `most_terms` terms of largest chi-square take part, so the table has a fixed bound.
    """
    named = labels.select("doc_id", label_domain().alias("_domain")).filter(F.col("_domain").isin(domains)).dropDuplicates(["doc_id"])
    prior = {r["_domain"]: r["count"] for r in named.groupBy("_domain").count().collect()}
    total = sum(prior.values())
    few = bounded_sample(named, F.col("_domain"), F.col("doc_id"), a_domain).select("doc_id", "_domain")
    sample = one_text_each(docs, few, "_domain")
    by_term = terms(sample, "_domain").groupBy("term").agg(*[F.sum((F.col("_domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    by_term = cut(by_term)
    row = by_term.filter("term = '#doc'").first()
    size = [row[f"n{i}"] if row else 0 for i in range(len(domains))]
    everything = sum(size)
    p = [(F.col(f"n{i}") + 0.5) / (size[i] + 1.0) for i in range(len(domains))]
    n = sum((F.col(f"n{i}") for i in range(1, len(domains))), F.col("n0"))
    overall = (n + 0.5) / (everything + 1.0)
    chi = sum((((p[i] - overall) ** 2) * size[i] / (overall * (1 - overall)) for i in range(1, len(domains))), ((p[0] - overall) ** 2) * size[0] / (overall * (1 - overall)))
    lift = F.greatest(*[x / overall for x in p], F.lit(0.0))
    kept = by_term.filter((F.col("term") != "#doc") & (n >= least_docs) & (lift >= least_lift) & (chi >= least_chi)).orderBy(F.desc(chi), "term").limit(most_terms)
    scored = cut(kept.select("term", F.array(*[F.log(x / (1 - x)) for x in p]).alias("w"), F.array(*[F.log(1 - x) for x in p]).alias("_absent")))
    start = scored.agg(*[F.coalesce(F.sum(F.col("_absent")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(domains))])
    base = [F.col(f"s{i}") + F.log(F.lit((prior.get(d, 0) + 0.5) / (total + 0.5 * len(domains)))) for i, d in enumerate(domains)]
    return scored.select("term", "w").unionByName(start.select(F.lit("#doc").alias("term"), F.array(*base).alias("w")))


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, _doc, tokens, p_<domain>...): one row for each distinct (doc_id, text). The model table is broadcast: `train` bounds it."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_doc"))
    known = sorted(r["term"] for r in model.select("term").collect() if not r["term"].startswith("#"))
    sums = terms(keyed, "doc_id", "_doc", known=known).join(F.broadcast(model), "term").groupBy("_doc", "doc_id").agg(F.max("tokens").alias("tokens"), F.count_if(F.col("term") == "#doc").alias("_rows"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(domains))])
    most = F.greatest(*[F.col(f"s{i}") for i in range(len(domains))], F.lit(float("-inf"))) / F.col("_rows")
    weights = [F.exp(F.col(f"s{i}") / F.col("_rows") - most) for i in range(len(domains))]
    whole = sum(weights[1:], weights[0])
    return sums.select("doc_id", "_doc", "tokens", "_rows", *[(w / whole).alias(f"p_{d}") for w, d in zip(weights, domains, strict=True)])


class Unmet(UserWarning):
    """Targets that no rates can meet: a domain has too little mass."""


def fit_rates(members: DataFrame, targets: dict[str, float], most_steps: int = 200, tolerance: float = 1e-8, reference: str | None = None) -> DataFrame:
    """`members` (tokens, _rows, p_<domain>...) with `rate` added, so that sum(rate * tokens * p_d) is near target d.

    Targets are shares of a total: the corpus's tokens, or, with `reference`, the total at which that domain keeps its own
    tokens (so its documents' rates stay near 1). A domain without any mass cannot be met and stays at its least squares.
    A step goes down the gradient, scaled by the curvature of the documents whose rate isn't 0 (one number for each pair of
    domains, summed with the totals), and negative rates become 0; where the sum of squares is not less then, the step is
    shorter, and at last the plain gradient's. It ends when the sum of squares falls by less than a ten-thousandth; a share that then differs from its target by
    over a hundredth of it is told by a warning.
    """
    weight = sum(targets.values())
    domains = list(targets)
    share = np.array([targets[d] / weight for d in domains])
    mass = (F.col("tokens") * F.col("_rows")).cast("double")
    p = [F.col(f"p_{d}") for d in domains]

    def measure(x: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Each domain's tokens at the rates x, the curvature, and all tokens."""
        moving = F.when(x > 0, mass)
        row = members.agg(*[F.sum(mass * x * c) for c in p], *[F.sum(moving * a * b) for a in p for b in p], F.sum(mass)).first()
        numbers = [float(v or 0) for v in row]
        n = len(domains)
        return np.array(numbers[:n]), np.array(numbers[n:-1]).reshape(n, n), numbers[-1]

    x: Column = F.lit(1.0)
    got, curvature, everything = measure(x)
    total = got[domains.index(reference)] / share[domains.index(reference)] if reference else everything
    if total <= 0:
        return members.withColumn("rate", x)
    scale = np.maximum(got / total, np.maximum(1e-3 * share, 1e-9))
    error_of = lambda t: float(((t / total - share) ** 2 / scale).sum())
    error = error_of(got)
    for step in range(1, most_steps + 1):
        if error < tolerance**2:
            break
        gap = got / total - share
        scaled = np.linalg.pinv(curvature / total, rcond=1e-9) @ gap
        # the last one, divided by each domain's mass, goes down in any case: no curvature is more than 1 then
        for move in (scaled, scaled / 4, gap / scale):
            option = F.greatest(F.lit(0.0), x - sum((F.lit(float(m)) * c for m, c in zip(move, p, strict=True)), F.lit(0.0)))
            now, bent, _ = measure(option)
            if error_of(now) < error:
                break
        else:
            break
        before, error, x, got, curvature = error, error_of(now), option, now, bent
        if step % 10 == 0:
            members = stored(members.withColumn("_x", x))
            x = F.col("_x")
        if before - error < 1e-4 * before:
            break
    unmet = {d: round(float(g) / total, 6) for d, g, s in zip(domains, got, share, strict=True) if abs(g / total - s) > 0.01 * s}
    if unmet:
        warnings.warn(f"targets {dict(zip(domains, share.tolist(), strict=True))} are not met: {unmet}", Unmet, stacklevel=2)
    return members.withColumn("rate", x).drop("_x")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], reference: str | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain>..., rate for each row of `docs`.

    A null or empty text has no tokens, its posteriors are those of a text without any known term, and its rate weighs
    nothing. Repeated rows get equal rates and are counted each. No documents give no rows; no labelled rows give equal
    posteriors.
    """
    domains = list(targets)
    members = cut(posteriors(docs, train(docs, labels, domains), domains))
    fitted = fit_rates(members, targets, reference=reference)
    return fitted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).select("doc_id", "tokens", *[f"p_{d}" for d in domains], "rate")


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: its rate rounded up or down by a hash, so that sums hold in expectation."""
    return F.floor(rate + uniform(key, F.lit("mix"))).cast("int")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], reference: str | None = None) -> DataFrame:
    """The rows of `docs`, each as often as its rate asks for: the rate rounded up or down by a hash of (doc_id, text), so the
    targets hold in expectation. Columns stay as they are."""
    domains = list(targets)
    members = cut(posteriors(docs, train(docs, labels, domains), domains))
    fitted = fit_rates(members, targets, reference=reference).select("_doc", copies(F.col("rate"), F.col("_doc")).alias("_copies"))
    changed = cut(fitted.filter("_copies <> 1"))
    small = changed.count() <= 2_000_000
    keyed = docs.withColumn("_doc", F.xxhash64("doc_id", "text"))
    joined = keyed.join(F.broadcast(changed) if small else changed, "_doc", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1))).filter("_copies > 0")
    return joined.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*docs.columns)
