"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

Terms are the words that tell most about the label (by chi-square, counted over a bounded labelled sample), pairs of neighbouring
character classes (letters of one case are one class, each ASCII sign is its own) and a few counts of words that repeat. The
sample gives the weights of terms and, by a truncated singular value decomposition, the latent vectors. The sample's vectors go
to every executor; each document's cosines with all of them are computed exactly, in blocks, and the nearest vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import bounded_sample, cut, fold, one_text_each, small_batches
from juncture.llm.words import blocks

#: Classes of bytes: other controls, lower, upper, digit, space, newline, beyond ASCII (a letter), then each ASCII sign.
_CLASS = np.zeros(256, dtype="int64")
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if "a" <= _c <= "z" or _b >= 128 else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t" else 5 if _c in "\n\r" else 0
for _i, _b in enumerate(b for b in range(33, 127) if not chr(b).isalnum()):
    _CLASS[_b] = 6 + _i
_N = int(_CLASS.max()) + 1
#: Terms that are no words: pairs of classes, then how often a word repeats its predecessor, repeats any, and all words.
PLAIN = _N * _N + 3


def features(column: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """(text, term): the counts of all terms in whole texts; zeros for a null or empty one. vocabulary: sorted word hashes."""
    out = np.zeros((len(column), PLAIN + len(vocabulary)), dtype="float32")
    for i, text in enumerate(column):
        if data := text.as_buffer() if text.is_valid else None:
            kinds = _CLASS[np.frombuffer(data, dtype="uint8")]
            out[i, : _N * _N] = np.bincount(kinds[:-1] * _N + kinds[1:], minlength=_N * _N)
    for block in blocks(column):
        word, row = block.word, np.repeat(block.row, np.diff(block.start))
        if not len(word):
            continue
        np.add.at(out[:, PLAIN - 3], row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], 1)
        order = np.lexsort((word, row))
        again = (word[order][1:] == word[order][:-1]) & (row[order][1:] == row[order][:-1])
        np.add.at(out[:, PLAIN - 2], row[order][1:][again], 1)
        np.add.at(out[:, PLAIN - 1], row, 1)
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            known = vocabulary[at] == word
            np.add.at(out, (row[known], PLAIN + at[known]), 1)
    return out


@dataclass
class Neighbours:
    """A fitted classifier: the words, term weights, the projection, the sample's unit vectors and labels."""

    vocabulary: np.ndarray
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    prior: float
    words: float

    def weigh(self, x: np.ndarray) -> np.ndarray:
        """Weighted terms: unit vectors of the plain ones beside `words` times unit vectors of the words."""
        x = np.sqrt(x) * self.idf
        norm = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return np.concatenate([norm(x[:, :PLAIN]), self.words * norm(x[:, PLAIN:])], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray, rank: int = 48, k: int = 15, words: float = 0.3) -> Neighbours:
        if not len(x):
            return cls(vocabulary, np.ones(PLAIN + len(vocabulary), "float32"), np.zeros((PLAIN + len(vocabulary), 1), "float32"), np.zeros((0, 1), "float32"), labels, k, 0.5, words)
        df = (x > 0).sum(axis=0)
        idf = np.log((1 + len(x)) / (1 + df)).astype("float32") + 1
        model = cls(vocabulary, idf, np.empty(0), np.empty(0), labels.astype("float32"), k, float(labels.mean()), words)
        w = model.weigh(x)
        # the leading right singular vectors, by subspace iteration from a fixed start
        q = np.random.default_rng(1).normal(size=(w.shape[1], min(rank + 16, *w.shape))).astype("float32")
        for _ in range(8):
            q = np.linalg.qr(w.T @ (w @ q))[0]
        values, vectors = np.linalg.eigh((w @ q).T @ (w @ q))
        model.projection = (q @ vectors[:, ::-1][:, : min(rank, len(values))]).astype("float32")
        model.vectors = model.unit(w @ model.projection)
        return model

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """The weighted vote for label 1 of each row; the sample's share of label 1 for rows without terms."""
        out = np.full(len(x), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.k, len(self.vectors))
        for at in range(0, len(x), block):
            rows = self.weigh(x[at : at + block])
            cosine = self.unit(rows @ self.projection) @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype("float64") ** 4
            total = weight.sum(axis=1)
            some = (total > 0) & (x[at : at + block].sum(axis=1) > 0)
            out[at : at + block][some] = ((weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300))[some]
        return np.clip(out, 0, 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row; among equals the first ones."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
    tied = np.flatnonzero((cosine >= least).sum(axis=1) > k)
    near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
    return near


def informative_words(texts: DataFrame, most: int, least_texts: int = 5) -> np.ndarray:
    """The hashes of the `most` words of largest chi-square between having the word and the label, sorted. texts: (_y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("_y").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                row = np.repeat(block.row, np.diff(block.start))
                pairs = np.unique(np.stack([row.astype("uint64"), block.word]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view("int64")), pa.array(labels[pairs[0].astype("int64")])], ["word", "_y"])

    n = {r["_y"]: r["count"] for r in texts.groupBy("_y").count().collect()}
    a, b = F.col("a") / max(n.get(1, 0), 1), F.col("b") / max(n.get(0, 0), 1)
    overall = (F.col("a") + F.col("b")) / max(sum(n.values()), 1)
    chi = (a - b) ** 2 / (overall * (1 - overall) + 1e-9)
    counts = texts.mapInArrow(run, "word long, _y int").groupBy("word").agg(F.count_if(F.col("_y") == 1).alias("a"), F.count_if(F.col("_y") == 0).alias("b"))
    best = counts.filter(F.col("a") + F.col("b") >= least_texts).orderBy(F.desc(chi), "word").limit(most).select("word").collect()
    return np.sort(np.array([r["word"] for r in best], dtype="int64").view("uint64"))


def train(docs: DataFrame, labelled: DataFrame, label: str, a_class: int = 1500, most_words: int = 1500) -> Neighbours:
    """Fits on at most `a_class` labelled rows of each class; `labelled` has (doc_id, label). Rows without a text or with
    another label than 0 or 1 teach nothing; without any the score is 0.5 everywhere."""
    small_batches(docs.sparkSession)
    few = bounded_sample(labelled.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y")).dropDuplicates(["doc_id"]), F.col("_y"), F.col("doc_id"), a_class)
    texts = cut(one_text_each(docs, few, "_y"))
    vocabulary = informative_words(texts, most_words)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for x in features(batch.column("text"), vocabulary)]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(rows, pa.binary())], ["_y", "x"])

    got = texts.mapInArrow(featurize, "_y int, x binary").toArrow()
    rows = sorted(zip(got.column("x").to_pylist(), got.column("_y").to_pylist(), strict=True))
    x = np.stack([np.frombuffer(r[0], dtype="float32") for r in rows]) if rows else np.zeros((0, PLAIN + len(vocabulary)), "float32")
    return Neighbours.fit(x, np.array([r[1] for r in rows]), vocabulary)


def score_documents(docs: DataFrame, model: Neighbours) -> DataFrame:
    """The rows of `docs` with `score` added; every column stays as it is, whatever its name but `score`, which is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            scores = []
            for start in range(0, batch.num_rows, 512):
                scores.append(fitted.score(features(batch.column(at).slice(start, 512), fitted.vocabulary)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], [*keep, "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return docs.select(*keep).mapInArrow(run, schema)


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labelled rows outside the held-out third.

    A null or empty text gets the sample's share of label 1. Repeated rows are scored each; a null doc_id is not held out. Of
    equally near neighbours those vote whose terms sort first. A text of any length counts whole.
    """
    model = train(docs, labels.filter(fold("doc_id", 3) != 1), "quality")
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
