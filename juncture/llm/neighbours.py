"""Approximate nearest neighbours: a forest of random-projection trees, one shared priority queue, exact reranking.

The trees' hyperplanes are chosen on a bounded sample; every vector is then put into its leaf in each tree. A query's queue
holds the leaves of all trees together; a leaf's priority is the sum of the margins on the way to it (how far the query lies
on that side of each hyperplane, which is what an inner product asks for), and leaves are taken until they hold a share of the
index that falls as the index grows. Candidates in them are scored by exact inner products in double precision, nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from juncture.llm.common import cut, uniform


@dataclass
class Forest:
    """directions: (trees, 2**depth - 1, dimension), thresholds: (trees, 2**depth - 1); nodes in heap order."""

    directions: np.ndarray
    thresholds: np.ndarray
    depth: int

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> Forest:
        """Each hyperplane lies between two random vectors of its node and halves the sample there."""
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        directions = rng.normal(size=(trees, nodes, sample.shape[1]))
        thresholds = np.zeros((trees, nodes))
        for t in range(trees):
            at = np.zeros(len(sample), dtype="int64")
            for node in range(nodes):
                own = np.flatnonzero(at == node)
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    if np.any(a != b):
                        directions[t, node] = a - b
                directions[t, node] /= np.linalg.norm(directions[t, node])
                projected = sample[own] @ directions[t, node]
                thresholds[t, node] = np.median(projected) if len(own) else 0.0
                at[own] = 2 * node + 1 + (projected >= thresholds[t, node])
        return cls(directions.astype("float32"), thresholds, depth)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, tree): the leaf of each vector, counted over the whole forest."""
        out = np.empty((len(vectors), len(self.directions)), dtype="int64")
        for t in range(len(self.directions)):
            at = np.zeros(len(vectors), dtype="int64")
            for _ in range(self.depth):
                margin = np.einsum("ij,ij->i", vectors, self.directions[t][at]) - self.thresholds[t][at]
                at = 2 * at + 1 + (margin >= 0)
            out[:, t] = at - (self.leaves - 1) + t * self.leaves
        return out

    def priorities(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, leaf of the forest): the sum of the margins on the way."""
        parts = []
        for t in range(len(self.directions)):
            margin = vectors @ self.directions[t].T - self.thresholds[t]
            level = np.zeros((len(vectors), 1))
            for d in range(self.depth):
                own = margin[:, (1 << d) - 1 : (1 << (d + 1)) - 1]
                below = np.empty((len(vectors), 2 << d))
                below[:, 0::2], below[:, 1::2] = level - own, level + own
                level = below
            parts.append(level)
        return np.concatenate(parts, axis=1)

    def visit(self, vectors: np.ndarray, counts: np.ndarray, want: float) -> list[np.ndarray]:
        """The leaves that each query takes from the queue until they hold `want` entries."""
        order = np.argsort(-self.priorities(vectors), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        return [o[(h - counts[o] < want) & (counts[o] > 0)] for o, h in zip(order, held, strict=True)]


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def share_of_entries(n: int) -> float:
    """Entries read for a query, as a multiple of n distinct vectors, with 4 trees: measured so that vectors without any
    structure (uniform on a sphere of 64 dimensions, the hardest case) keep a recall of 0.9 from 500 to 50,000 vectors."""
    return min(1.3, 1.1 * (2000 / max(n, 1)) ** 0.25)


@dataclass
class Cells:
    """Leaves in groups of about `rows` entries that one task reads: neighbouring leaves of a tree together, a larger leaf in pieces."""

    first: np.ndarray
    pieces: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, rows: int) -> Cells:
        pieces = np.maximum(1, -(-counts // rows))
        first, cell, held = np.zeros(len(counts), dtype="int64"), 0, 0
        for leaf, (n, p) in enumerate(zip(counts.tolist(), pieces.tolist(), strict=True)):
            if held and (p > 1 or held + n > rows):
                cell, held = cell + 1, 0
            first[leaf] = cell
            held += n
            if p > 1:
                cell, held = cell + p, 0
        return cls(first, pieces)


class Best:
    """The k best (score, then least id) entries of each query, of all that were offered."""

    def __init__(self, queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.queries, self.data, self.ids, self.k = queries, data, ids, k
        self.floor = np.full(len(queries), -np.inf)
        # a product in blocks may differ from a sum row by row in its last bits
        self.slack = 1e-13 * np.linalg.norm(queries, axis=1) * (np.linalg.norm(data, axis=1).max() if len(data) else 0.0)
        self.held: list[tuple] = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        self.n = 0

    def offer(self, who: np.ndarray, a: int, b: int) -> None:
        rough = self.queries[who] @ self.data[a:b].T
        row, at = np.nonzero(rough >= (self.floor[who] - self.slack[who])[:, None])
        if len(row):
            q, entry = who[row], at + a
            # row by row, so that equal vectors get equal scores whatever block they came in
            self.held.append((q, entry, np.einsum("ij,ij->i", self.queries[q], self.data[entry])))
            self.n += len(row)
            if self.n > max(1 << 18, 4 * self.k * len(self.queries)):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, entry, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((self.ids[entry], -score, q))
        q, entry, score = q[order], entry[order], score[order]
        if len(q):
            own = self.ids[entry]
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (own[1:] != own[:-1])])
            q, entry, score = q[new], entry[new], score[new]
            nth = np.arange(len(q)) - np.searchsorted(q, q, "left")
            last = nth == self.k - 1
            self.floor[q[last]] = score[last]
            keep = nth < self.k
            q, entry, score = q[keep], entry[keep], score[keep]
        self.held, self.n = [(q, entry, score)], len(q)
        return q, entry, score


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 4, leaf_size: int = 32, most_leaves: int = 4096, share: float | None = None, most_sample: int = 16384, cell_rows: int = 40_000, block_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of largest inner product among the candidates found.

    Takes (vec_id, embedding). `share` is the number of index entries read for a query, as a multiple of the number of
    distinct vectors, over all trees; by default `share_of_entries`. Rows that `usable` refuses, rows with a null id and rows
    of another dimension than the commonest take no part. Equal vectors are one entry with their k + 1 least ids, so a vector
    that most rows share costs no more than another, and ties go to the smaller id. A table of fewer than k + 1 rows yields
    all; repeated ids of one vector are one row; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("_q")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == sizes["d"]).withColumn("rid", F.xxhash64("v"))
    first = Window.partitionBy("rid").orderBy("vec_id")
    few = rows.select("rid", "vec_id", "v").withColumn("_n", F.rank().over(first)).filter(F.col("_n") <= k + 1).drop("_n").distinct()
    index = cut(few.groupBy("rid").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v")))
    queries = cut(rows.filter("_q").select("vec_id", "rid").distinct())
    n = index.count()
    sample = index.filter(uniform(F.col("rid")) < min(1.0, most_sample / max(n, 1))).select("rid", "v").toPandas().sort_values("rid")
    depth = max(0, min(int(np.log2(most_leaves)), int(np.ceil(np.log2(max(n, 1) / leaf_size))) if n > leaf_size else 0))
    sampled = np.stack(sample["v"]).astype("float64") if len(sample) else np.zeros((1, sizes["d"]))
    forest = spark.sparkContext.broadcast(Forest.grow(sampled, trees if depth else 1, depth))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = forest.value.leaf(_matrix(batch.column("v")))
            at = np.repeat(np.arange(batch.num_rows), leaf.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), *batch.take(pa.array(at)).columns], ["leaf", "rid", "ids", "v"])

    in_leaves = index.select("rid", "ids", "v").mapInArrow(settle, "leaf long, rid long, ids array<long>, v array<double>")
    counts = np.zeros(forest.value.leaves * len(forest.value.directions), dtype="int64")
    for row in in_leaves.groupBy("leaf").count().collect():
        counts[row["leaf"]] = row["count"]
    held, want = spark.sparkContext.broadcast((counts, Cells.of(counts, cell_rows))), (share or share_of_entries(n)) * n
    asked = index.join(queries.select("rid").distinct(), "rid").select("rid", "v")
    blocks = max(1, -(-asked.count() // block_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value[1]
        for batch in batches:
            leaf, rid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "rid"))
            yield pa.RecordBatch.from_arrays([pa.array(cells.first[leaf] + rid % cells.pieces[leaf]), *batch.columns], ["cell", "leaf", "rid", "ids", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cells = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                rid = some.column("rid").to_numpy(zero_copy_only=False)
                at, cell, leaves = [], [], []
                for i, own in enumerate(forest.value.visit(_matrix(some.column("v")), counts, want)):
                    own = np.sort(own)
                    own = np.repeat(own, cells.pieces[own])
                    nth = np.arange(len(own)) - np.searchsorted(own, own, "left")
                    to = cells.first[own] + nth
                    order = np.argsort(to, kind="stable")
                    own, to = own[order], to[order]
                    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
                    for a, b in zip(edges, [*edges[1:], len(to)], strict=True):
                        at.append(i)
                        cell.append(to[a])
                        leaves.append(own[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(rid[at] % blocks, pa.int64()), some.column("rid").take(pa.array(at, pa.int64())), some.column("v").take(pa.array(at, pa.int64())), pa.array(leaves, pa.list_(pa.int64()))], ["cell", "block", "q", "v", "leaves"])

    def search(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = pa.table({"q": pa.array([], pa.int64()), "rid": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return nothing
        left = left.sort_by("leaf").combine_chunks()
        leaf, ids = left.column("leaf").to_numpy(), left.column("ids").combine_chunks()
        data, asked_v = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        lists = right.column("leaves").combine_chunks()
        names = np.unique(leaf)
        # queries by the leaf that they visit
        who = np.repeat(np.arange(right.num_rows), np.diff(lists.offsets.to_numpy()))
        visited = lists.flatten().to_numpy()
        order = np.argsort(visited, kind="stable")
        who, visited = who[order], visited[order]
        best = Best(asked_v, data, ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()], k + 1)
        for name in names:
            mine = who[np.searchsorted(visited, name, "left") : np.searchsorted(visited, name, "right")]
            if len(mine):
                best.offer(mine, int(np.searchsorted(leaf, name, "left")), int(np.searchsorted(leaf, name, "right")))
        q, entry, score = best.cut()
        if not len(q):
            return nothing
        return pa.table({"q": right.column("q").to_numpy()[q], "rid": left.column("rid").to_numpy()[entry], "ids": ids.take(pa.array(entry)), "score": score})

    block_numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))) if blocks > 1 else F.lit(0).cast("long")
    stored = in_leaves.mapInArrow(place, "cell long, leaf long, rid long, ids array<long>, v array<double>").withColumn("block", block_numbers)
    visits = asked.mapInArrow(visit, "cell long, block long, q long, v array<double>, leaves array<long>")
    found = stored.groupBy("cell", "block").cogroup(visits.groupBy("cell", "block")).applyInArrow(search, "q long, rid long, ids array<long>, score double")
    distinct = found.groupBy("q", "rid").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = distinct.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k + 1)
    single = top.select("q", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    lists = single.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_n", "id", "score"))).alias("_top"))
    answered = queries.join(lists, F.col("rid") == F.col("q")).select(F.col("vec_id").alias("query_id"), "_top")
    own = F.slice(F.filter("_top", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = answered.select("query_id", F.posexplode(own).alias("_at", "_x"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score"))
