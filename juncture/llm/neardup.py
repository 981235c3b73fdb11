"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has `hashes` symbols of 16 bits, the low ends of minimal shingle hashes. It is cut into chunks so that, by the
pigeonhole, two signatures within the allowed distance agree in some chunk but for at most one symbol; each chunk is indexed
once for each symbol left out, so every pair under the distance threshold meets. A bucket is not expanded into pairs: each
member is compared with the bucket's least member, its pivot, and only what this leaves unconnected is compared with the
others of that pivot, in blocks inside tasks. Links are confirmed on the full sets of the texts, and components are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from juncture.llm.common import cut, of_rows, row_key, small_batches
from juncture.llm.words import Block, blocks
from juncture.llm.words import mix as _mix

#: Of pairs with similarity 0.80 about 3e-6 have more unlike symbols than DISTANCE, of pairs with 0.85 about 1e-8 (binomial).
HASHES, CHUNKS, SHINGLE = 48, 12, 5
#: Two signatures with at most this many unlike symbols share a chunk but for one symbol.
DISTANCE = 2 * CHUNKS - 1
#: Ids that may be broadcast (8 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 4_000_000

_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(1, 1 << 63, HASHES, dtype="uint64") * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype="uint64")
_PLACES = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype="uint64") * np.uint64(2) + np.uint64(1)
_LEFT_OUT = np.arange(HASHES, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
_BOUNDS = np.linspace(0, HASHES, CHUNKS + 1).astype(int)


def _of_block(block: Block, rows: int) -> list[np.ndarray]:
    """The sets of the `rows` texts from the first one of a block on."""
    first = int(block.row[0])
    edges = np.append(block.start[np.searchsorted(block.row, np.arange(first, first + rows))], len(block.word))
    w, n = block.word, len(block.word)
    h = np.full(max(n - SHINGLE + 1, 0), SHINGLE, dtype="uint64")
    for i in range(SHINGLE):
        h += _mix(w[i : i + len(h)] + _PLACES[i]) * _PLACES[i]
    h = _mix(h)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.full(1, b - a, dtype="uint64")
            for i in range(b - a):
                short += _mix(w[a + i : a + i + 1] + _PLACES[i]) * _PLACES[i]
            out.append(_mix(short))
        else:
            out.append(np.empty(0, dtype="uint64"))
    return out


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct 5-word shingles; of its whole sequence, with fewer words."""
    out: list[np.ndarray] = []
    for block in blocks(column):
        out += _of_block(block, int(block.row[-1] - block.row[0]) + 1)
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]


def signature(h: np.ndarray) -> np.ndarray:
    """The 16-bit symbols of a nonempty set."""
    least = np.full(HASHES, ~np.uint64(0), dtype="uint64")
    for at in range(0, len(h), 4096):
        np.minimum(least, (h[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype("uint16")


def keys(signatures: np.ndarray) -> np.ndarray:
    """(row, key): of each chunk, the hash of its symbols but one, for each one left out."""
    mixed = _mix(signatures.astype("uint64") + (np.arange(HASHES, dtype="uint64") << np.uint64(20)) + np.uint64(1))
    out = np.empty((len(signatures), HASHES), dtype="uint64")
    for c in range(CHUNKS):
        a, b = _BOUNDS[c], _BOUNDS[c + 1]
        total = mixed[:, a:b].sum(axis=1)
        for i in range(a, b):
            out[:, i] = _mix(total - mixed[:, i] + _LEFT_OUT[i : i + 1])
    return out.view("int64")


def sketch(docs: DataFrame) -> DataFrame:
    """_row, _id, n_shingles, set_key (a digest of the full set; null if empty), sig, of (_row, _id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            digest = [blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in sets]
            sig = [signature(h).tobytes() if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["_row", "_id", "n_shingles", "set_key", "sig"])

    return docs.select("_row", "_id", "text").mapInArrow(run, "_row long, _id long, n_shingles long, set_key binary, sig binary")


def entries(reps: DataFrame) -> DataFrame:
    """(key, rep) for every chunk key of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                sig = np.frombuffer(b"".join(some.column("sig").to_pylist()), dtype="uint16").reshape(-1, HASHES)
                rep = np.repeat(some.column("rep").to_numpy(zero_copy_only=False), HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(keys(sig).ravel()), pa.array(rep)], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def within(df: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The pairs (a, b) of (a, b, sig_a, sig_b) with at most `distance` unlike symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="uint16").reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
                yield batch.filter(pa.array((sides[0] != sides[1]).sum(axis=1) <= distance)).select(["a", "b"])

    return df.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, np.empty(0, dtype="uint64")
        for batch in batches:
            good = []
            for at, (a, other) in enumerate(zip(batch.column("a").to_pylist(), shingle_sets(batch.column("text_b")), strict=True)):
                if a != last:
                    last, of_last = a, shingles(batch.column("text_a")[at].as_py())
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                good.append(100 * both >= percent * (len(of_last) + len(other) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    of_b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(rep, root) for every node of `edges` (a, b) but the roots, the least nodes of their components.

    Large-star and small-star contraction (Kiveris et al. 2014) on shuffled tables until nothing changes.
    """

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = digest(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        after = digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("rep"), F.col("v").alias("root"))


def _with_sigs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    return pairs.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")


def _blocks(members: DataFrame, size: int) -> DataFrame:
    """members (pivot, rep, root, main) dealt to pairs of blocks (pivot, i, j) of at most about `size` members a side.

    Blocks of the rest (root <> main) meet each other and the blocks of the main component, which don't meet among themselves.
    """
    rest = F.col("root") != F.col("main")
    counts = members.groupBy("pivot").agg(F.ceil(F.count_if(rest) / size).alias("nr"), F.ceil(F.count_if(~rest) / size).alias("nm"), F.count("*").alias("n")).filter("nr > 0 and n > 1").select("pivot", "nr", "nm")
    counts = cut(counts)  # a table of its own, so that a pivot of many members is no task's alone in the join
    dealt = members.join(F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts, "pivot").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(rest, F.col("nr")).otherwise(F.greatest("nm", F.lit(1)))))
    low, high = F.lit(0).cast("long"), F.col("nr") - 1
    with_rest = F.transform(F.sequence(low, high), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    with_main = F.when(F.col("nm") > 0, F.transform(F.sequence(low, F.greatest("nm", F.lit(1)) - 1), lambda k: F.struct(F.col("own").alias("i"), (F.col("nr") + k).alias("j"))))
    as_main = F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("i"), (F.col("nr") + F.col("own")).alias("j")))
    places = F.when(rest, F.concat(with_rest, F.coalesce(with_main, F.array().cast("array<struct<i:bigint,j:bigint>>")))).otherwise(as_main)
    return dealt.withColumn("at", F.explode(places)).select("pivot", "at.i", "at.j", "rep", "root", (F.col("root") == F.col("main")).alias("is_main"))


def _cross(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that may link: unlike roots, not both of the main component, within the distance."""
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="uint16").reshape(-1, HASHES)
    root, main = table.column("root").to_numpy(), table.column("is_main").to_numpy()
    n = table.column("n_shingles").to_numpy()
    ok = np.triu(root[:, None] != root[None, :], 1) & ~(main[:, None] & main[None, :])
    ok &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    x, y = np.nonzero(ok)
    near = np.concatenate([(sig[x[a : a + 65536]] != sig[y[a : a + 65536]]).sum(axis=1) <= DISTANCE for a in range(0, len(x), 65536)]) if len(x) else np.zeros(0, dtype=bool)
    return x[near], y[near]


def _links(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, roots: list[int], percent: int) -> list[tuple[int, int]]:
    """Of the pairs (x, y) those that link, as far as they connect what others have not."""
    parent: dict[int, int] = {r: r for r in roots}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    out = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        u, v = find(roots[a]), find(roots[b])
        if u != v:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[u] = v
                out.append((a, b))
    return out


def residual_links(members: DataFrame, reps: DataFrame, texts_of, percent: int, size: int = 128) -> DataFrame:
    """(a, b): links between members (pivot, rep, root, main) of unlike roots that share a pivot, enough of them to connect all
    that is connected. Blocks are compared inside tasks: first their signatures, then, of members with a near partner, the texts."""
    sigs = reps.select("rep", "sig", "n_shingles")

    def near(table: pa.Table) -> pa.Table:
        x, y = _cross(table, percent)
        some = table.take(pa.array(np.unique(np.concatenate([x, y])), pa.int64()))
        return some.select(["pivot", "rep"])

    def link(table: pa.Table) -> pa.Table:
        x, y = _cross(table, percent)
        sets = [x for chunk in table.column("text").chunks for x in shingle_sets(chunk)]
        rep = table.column("rep").to_pylist()
        found = _links(sets, x, y, table.column("root").to_pylist(), percent)
        return pa.table({"a": pa.array([rep[a] for a, _ in found], pa.int64()), "b": pa.array([rep[b] for _, b in found], pa.int64())})

    first = _blocks(members, 8 * size).join(sigs, "rep").groupBy("pivot", "i", "j").applyInArrow(near, "pivot long, rep long")
    involved = cut(members.join(first.distinct(), ["pivot", "rep"]))
    texts = texts_of(involved.select("rep"))
    blocks = _blocks(involved, size).join(sigs, "rep").join(texts, "rep")
    return blocks.groupBy("pivot", "i", "j").applyInArrow(link, "a long, b long")


def groups(docs: DataFrame, percent: int) -> DataFrame:
    """_row, _id, n_shingles, root for every row of `docs` (_row, _id, text): rows of one root are linked, by way of others too.

    Texts with equal sets are one representative, so copies cost nothing beyond the first. Rows without shingles have no root.
    """
    small_batches(docs.sparkSession)
    sketched = cut(sketch(docs))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", F.col("_row").alias("own"), "sig", "n_shingles")).alias("r")
    sets = sketched.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(least).select("set_key", "r.*")
    # named by its least id, so that a bucket's pivot is its earliest text; the second set of an id by a hash
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("set_key"))
    name = F.when(F.col("_id").isNotNull() & (F.col("_nth") == 1), F.col("_id")).otherwise(F.xxhash64("set_key"))
    single = sets.filter("_id is not null").withColumn("_nth", nth).unionByName(sets.filter("_id is null").withColumn("_nth", F.lit(1)))
    reps = cut(single.select("set_key", name.alias("rep"), "own", "sig", "n_shingles"))
    met = entries(reps)
    buckets = met.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot")
    stars = cut(met.join(buckets.hint("shuffle_hash"), "key").filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    pairs = cut(within(_with_sigs(stars, reps)))
    source = docs.filter(F.col("text").isNotNull()).select("_row", "text")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = cut(reps.join(ids.toDF("rep").distinct(), "rep", "left_semi").select("rep", F.col("own").alias("_row")))
        return cut(of_rows(source, wanted, "inner").dropDuplicates(["rep"]).select("rep", "text"))

    first = cut(confirmed(pairs, texts_of(pairs.select("a").union(pairs.select("b"))), percent))
    roots = components(first)
    of_pivot = roots.select(F.col("rep").alias("a"), F.col("root").alias("main"))
    of_member = roots.select(F.col("rep").alias("b"), "root")
    labelled = stars.join(of_pivot, "a", "left").join(of_member, "b", "left")
    members = cut(labelled.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), F.coalesce("root", "b").alias("root"), F.coalesce("main", "a").alias("main")))
    more = cut(residual_links(members, reps, texts_of, percent))
    final = roots if more.isEmpty() else components(first.unionByName(more))
    rooted = reps.select("set_key", "rep").join(final, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    return sketched.select("_row", "_id", "n_shingles", "set_key").join(rooted, "set_key", "left").select("_row", "_id", "n_shingles", "root")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text).

    A null or empty text, or one of white space, has no shingles and is linked with nothing. Rows that share a doc_id each
    take the component of their own text. A row with a null doc_id takes no part in links: its component_id is null and it
    is kept. A text of any length is shingled whole.
    """
    rows = docs.select("doc_id", row_key(docs).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text")
    found = cut(groups(rows.filter("_id is not null"), percent))
    least = found.filter("root is not null").groupBy("root").agg(F.min("_id").alias("least"))
    least = cut(least.join(found.filter("root is not null").groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"), "root", "left_semi"))
    linked = found.join(F.broadcast(least) if least.count() <= MOST_BROADCAST else least, "root", "left").withColumn("component_id", F.coalesce("least", "_id"))
    kind = docs.schema["doc_id"].dataType
    out = linked.select(F.col("_id").cast(kind).alias("doc_id"), "n_shingles", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter("_id is null")
    single = sketch(alone).select(F.lit(None).cast(kind).alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(single)


def one_of_each(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of `docs` (doc_id, text and others), one of each group of linked ones: that of the least doc_id (null is the
    greatest), then of the least hash of (doc_id, text); of rows equal in both, one. Rows without shingles stay, all of them."""
    keyed = docs.withColumn("_row", row_key(docs)).withColumn("_id", F.col("doc_id").cast("long"))
    found = cut(groups(keyed.select("_row", "_id", "text"), percent).filter("root is not null"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("p"), F.count("*").alias("n")).filter("n > 1")
    stays = cut(first.select("root", F.col("p._row").alias("_row")))
    more = found.join(stays.select("root"), "root", "left_semi").select("_row").distinct().join(stays.select("_row"), "_row", "left_anti")
    rest = of_rows(keyed, cut(more), "left_anti")
    twice = cut(found.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").join(stays.select("_row"), "_row", "left_semi").select("_row"))
    single = of_rows(rest, twice, "left_anti").unionByName(of_rows(rest, twice, "left_semi").dropDuplicates(["_row"]))
    return single.select(*docs.columns)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.v WHERE r.root < e.y),
c AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""
