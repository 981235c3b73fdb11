"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words that a text has is fitted from confirmed toxic texts and unlabelled ones. Its risk is
prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]), the estimator that stays sound when the unlabelled texts
hold toxic ones (Kiryo et al. 2017); where the second term turns negative its gradient is reversed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from juncture.llm.common import bounded_sample, fold, one_text_each, small_batches

_WORD = re.compile(r"\w+")


def buckets(text: str | None, bits: int) -> np.ndarray:
    """The hashed distinct words of a whole text and the hashed starts of its longer words, sorted."""
    words = set(_WORD.findall(text.lower())) if text else set()
    words |= {w[:5] + "*" for w in words if len(w) > 5}
    digest, mask = xxhash.xxh3_64_intdigest, (1 << bits) - 1
    return np.unique(np.fromiter((digest(w.encode("utf-8", "replace")) & mask for w in words), dtype="int64", count=len(words)))


@dataclass
class Linear:
    """Hashed word weights and a bias."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, text: str | None) -> float:
        margin = self.bias + float(self.weights[buckets(text, self.bits)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int, steps: int = 400, rate: float = 0.1, decay: float = 3e-5, least_texts: int = 4, least_lift: float = 3.0, deviations: float = 4.0) -> Linear:
    """Full-batch Adam on the non-negative risk with logistic loss and weights of at least 0.

    Buckets in fewer than least_texts confirmed texts, not least_lift times as common there as among the unlabelled, or
    within so many standard deviations of what chance would give, stay out: with few confirmed texts the rest would only be fitted noise.
    """
    out = Linear(np.zeros(1 << bits, dtype="float32"), -4.0, bits)
    if not positive or not unlabelled:
        return out
    seen = np.bincount(np.concatenate(positive), minlength=1 << bits)
    common = np.bincount(np.concatenate(unlabelled), minlength=1 << bits)
    expected = common * (len(positive) / len(unlabelled))
    used = np.flatnonzero((seen >= min(least_texts, len(positive))) & (seen >= least_lift * expected) & (seen >= expected + deviations * np.sqrt(expected)))
    place = np.full(1 << bits, -1, dtype="int64")
    place[used] = np.arange(len(used))

    def compact(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        cols = [p[p >= 0] for p in (place[t] for t in texts)]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols), len(cols)

    sets = compact(positive), compact(unlabelled)
    w, b = np.zeros(len(used)), -2.0
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        margins = [b + np.bincount(r, weights=w[c], minlength=n) for r, c, n in sets]
        p, u = (1 / (1 + np.exp(-np.clip(m, -60, 60))) for m in margins)
        negative = _softplus(margins[1]).mean() - prior * _softplus(margins[0]).mean()
        # d loss(+) = p - 1; d loss(-) = p
        if negative >= 0:
            by_row = prior * ((p - 1) - p) / len(p), u / len(u)
        else:
            by_row = prior * p / len(p), -u / len(u)
        gradient = np.zeros(len(used) + 1)
        for (r, c, _), g in zip(sets, by_row, strict=True):
            gradient[:-1] += np.bincount(c, weights=g[r], minlength=len(used))
            gradient[-1] += g.sum()
        gradient[:-1] += decay
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    out.weights[used] = w
    out.bias = float(b)
    return out


def train(docs: DataFrame, labelled: DataFrame, label: str, most: int = 3000, most_unlabelled: int = 12000, bits: int = 20) -> Linear:
    """Fits on at most `most` confirmed toxic texts and `most_unlabelled` texts of any kind.

    The class prior is the share of toxic rows among `labelled` (doc_id, label). The unlabelled texts are drawn from all
    documents by a hash of their id, without a look at labels.
    """
    known = labelled.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y")).dropDuplicates(["doc_id"])
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    prior = min(max(toxic / n if n else 0.0, 1e-3), 0.5)
    chosen = bounded_sample(known.filter("_y = 1"), F.lit("toxic"), F.col("doc_id"), most).select("doc_id", F.lit(1).alias("_y"))
    positive = one_text_each(docs, chosen, "_y")
    ids = bounded_sample(docs.select("doc_id").filter("doc_id is not null"), F.lit("any"), F.col("doc_id"), most_unlabelled).select("doc_id", F.lit(0).alias("_y"))
    drawn = one_text_each(docs, ids.distinct(), "_y")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [buckets(t, bits).astype("int32").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(rows, pa.binary())], ["_y", "x"])

    got = positive.unionByName(drawn).mapInArrow(featurize, "_y int, x binary").toArrow()
    rows = sorted(zip(got.column("_y").to_pylist(), got.column("x").to_pylist(), strict=True))
    sides = {y: [np.frombuffer(x, dtype="int32").astype("int64") for k, x in rows if k == y] for y in (0, 1)}
    return fit(sides[1], sides[0], prior, bits)


def score_documents(docs: DataFrame, model: Linear) -> DataFrame:
    """The columns of `docs` with `score` added (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            scores = [fitted.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*keep, "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return docs.select(*keep).mapInArrow(run, schema)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labelled rows outside the held-out fifth.

    A null or empty text gets the score of a text without known words (below 0.5). Repeated rows are scored each; a null
    doc_id is not held out. Without a confirmed toxic text nothing is predicted toxic.
    """
    model = train(docs, labels.filter(fold("doc_id", 5) != 0), "toxic")
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
