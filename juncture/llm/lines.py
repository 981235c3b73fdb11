"""Line deduplication by an exact set-similarity join.

A line is the set of its words (64-bit hashes); it goes if an earlier line (by doc_id, then place) has a Jaccard similarity of
at least 0.8 with it. Words are ordered by rarity over the whole corpus; two lines can only match if the prefixes of their
rarest words share one, so prefixes are indexed and met word by word. Candidates must pass the length filter, the positional
filter and a lower bound of the symmetric difference (the words' bits in 64 to 512 places, summed mod 2); what passes is
verified on the full sets.

No text is shuffled for the search: a prefix entry names its line and carries its length, place and parity bits, and entries
travel packed by column. A word with very many entries is divided by a hash of the line; lines for which that, or the number
of candidates kept at first, leaves something open are met with the sets of all lines that share a prefix word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import cut, small_batches, stored
from juncture.llm.words import Block, blocks, mix

#: Words are counted in 2**COUNTER_BITS counters; two words that share one look as common as both together.
COUNTER_BITS = 24
_FAN = 1024
#: Entries of a word beyond which it is divided; entries for each part of the index; candidates of a line kept at first.
MOST_OF_A_WORD, PART, FIRST_CANDIDATES = 1 << 20, 1 << 18, 64
#: Of a line whose likest candidate has at most half the unlike bits that are allowed, so many are kept at first.
CLEAR_CANDIDATES = 2
#: Sizes beyond which a line has 128, 256 and 512 parity bits instead of 64.
WIDER = (48, 96, 192)
#: Lines or words whose hashes may be broadcast (16 bytes each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 4_000_000

_PARITY = tuple(f"p{i}" for i in range(8))
#: Which parity columns there are beyond each of WIDER.
_EXTRA = (_PARITY[1:2], _PARITY[2:4], _PARITY[4:8])
_ENTRY = ("token", "doc_id", "sub", "shape", *_PARITY)
_ENTRY_SCHEMA = ", ".join(f"{c} long" for c in _ENTRY)
_FOUND = ("x_doc", "x_sub", "unlike", "y_doc", "y_sub", "more")


def _counter(word: np.ndarray) -> np.ndarray:
    return (word & np.uint64((1 << COUNTER_BITS) - 1)).astype("int64")


class Sets:
    """The sets of a block of lines, each in one order of words: rarest first, then by hash.

    doc, sub: a line's name, sub being 32 bits of its text's hash and its number there. parity: the sum mod 2 of the words'
    places among 64 (p0), then, for wider ones, of those words alone that lie in the first half of 128 (p1), in the first half
    of either half of 256 (p2, p3) and so on (p4 to p7); what is left out follows by subtraction.
    """

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, block: Block, level: np.ndarray | None) -> None:
        full = np.flatnonzero(np.diff(block.start))
        self.doc = ids[block.row[full]]
        self.sub = _sub(hashes[block.row[full]], block.line[full])
        line = np.repeat(np.arange(len(full), dtype="uint64"), np.diff(block.start)[full])
        word = block.word
        rank = np.zeros(len(word), dtype="uint8") if level is None else level[_counter(word)]
        key = (line << np.uint64(40)) | (rank.astype("uint64") << np.uint64(32)) | (word >> np.uint64(32))
        order = np.argsort(key)
        key, word, rank = key[order], word[order], rank[order]
        same = key[1:] == key[:-1]
        if np.any(same & (word[1:] != word[:-1])):
            order = np.lexsort((word, key))
            key, word, rank = key[order], word[order], rank[order]
            same = (key[1:] == key[:-1]) & (word[1:] == word[:-1])
        new = np.concatenate([np.ones(min(len(key), 1), dtype=bool), ~same])
        self.word, self.rank, self.line = word[new], rank[new], (key[new] >> np.uint64(40)).astype("int64")
        self.size = np.bincount(self.line, minlength=len(full))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        if not len(full):
            self.set_id, self.parity = np.empty(0, dtype="int64"), np.zeros((8, 0), dtype="uint64")
            return
        mixed = mix(self.word)
        self.set_id = mix(np.add.reduceat(mixed, self.start[:-1]) + self.size.astype("uint64")).view("int64")
        self.parity = np.zeros((8, len(full)), dtype="uint64")
        if level is None:
            return  # no entries are made of these
        bit = np.uint64(1) << (mixed >> np.uint64(58))
        self.parity[0] = np.bitwise_xor.reduceat(bit, self.start[:-1])
        # of the bits that choose among 2, 4 and 8 words of 64 places: the last one chosen is 0
        for k, (least, columns) in enumerate(zip(WIDER, ((1,), (2, 3), (4, 5, 6, 7)), strict=True)):
            wide = np.flatnonzero(self.size > least)
            if not len(wide):
                break
            inside = (self.size > least)[self.line]
            which, own = mixed[inside] & np.uint64((2 << k) - 1), bit[inside]
            start = np.concatenate([[0], np.cumsum(self.size[wide])[:-1]])
            for j, c in enumerate(columns):
                self.parity[c, wide] = np.bitwise_xor.reduceat(np.where(which == np.uint64(j), own, np.uint64(0)), start)

    def prefixes(self, chosen: np.ndarray) -> np.ndarray:
        """Where the prefix words of the chosen lines are. Words that no other line has are left out."""
        length = self.size - -(-self.size * 4 // 5) + 1
        inside = np.arange(len(self.word)) - self.start[self.line]
        # a line of up to three words matches equal sets alone
        return np.flatnonzero((chosen & (self.size > 3))[self.line] & (inside < length[self.line]) & (self.rank > 0))

    def entries(self, at: np.ndarray) -> dict[str, np.ndarray]:
        own = self.line[at]
        shape = (self.size[own] << 32) | (at - self.start[own])
        out = {"token": self.word[at].view("int64"), "doc_id": self.doc[own], "sub": self.sub[own], "shape": shape}
        return out | {c: self.parity[i, own].view("int64") for i, c in enumerate(_PARITY)}


def _sets(batches: Iterator[pa.RecordBatch], level: np.ndarray | None, names: np.ndarray | None = None, counters: np.ndarray | None = None) -> Iterator[Sets]:
    """The sets of all lines; of those in the sorted `names`; or of those with a word of a marked counter."""
    for batch in batches:
        if names is not None:
            batch = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), names["doc"])))
        ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
        for block in blocks(batch.column("text")):
            for some in block.parts(1 << 20):
                if names is not None:
                    some = some.only(_among(ids[some.row], _sub(hashes[some.row], some.line), names))
                elif counters is not None:
                    marked = np.concatenate([[0], np.cumsum(counters[_counter(some.word)])])
                    some = some.only(marked[some.start[1:]] > marked[some.start[:-1]])
                yield Sets(ids, hashes, some, level)


def _sub(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    return ((h.astype("uint64") << np.uint64(32)) | line.astype("uint64")).view("int64")


class _New:
    """Which sets a task meets for the first time, or at an earlier place than before."""

    def __init__(self) -> None:
        self.met: dict[int, tuple[int, int]] = {}

    def __call__(self, sets: Sets) -> np.ndarray:
        out = np.zeros(len(sets.size), dtype=bool)
        for i, key in enumerate(zip(sets.set_id.tolist(), sets.doc.tolist(), sets.sub.tolist(), strict=True)):
            s, place = key[0], key[1:]
            if s not in self.met or place < self.met[s]:
                self.met[s] = place
                out[i] = True
        return out


def survey(docs: DataFrame) -> DataFrame:
    """Rows with part null: (set_id, doc_id, sub) of each line with words. The others: counters of one part of the corpus,
    part by part, as pairs of place and count in `counts`."""
    names = ["part", "counts", "set_id", "doc_id", "sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, held, seen = _New(), [], (np.empty(0, dtype="int64"), np.empty(0, dtype="int64"))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, n = np.unique(np.concatenate(held).astype("uint32"), return_counts=True)
            both = np.concatenate([seen[0], own])
            order = np.argsort(both, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(both[order]) != 0]))
            return both[order][at], np.add.reduceat(np.concatenate([seen[1], n])[order], at)

        for sets in _sets(batches, None):
            held.append(_counter(sets.word[new(sets)[sets.line]]))
            if sum(map(len, held)) > 1 << 20:
                seen, held = merged(), []
            n = len(sets.size)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(sets.set_id), pa.array(sets.doc), pa.array(sets.sub)], names)
        if sum(map(len, held)):
            seen = merged()
        width, most = (1 << COUNTER_BITS) // _FAN, np.iinfo("uint16").max
        # counts beyond 16 bits go in several pairs
        times = -(-seen[1] // most)
        place, amount = np.repeat(seen[0], times), np.full(int(times.sum()), most)
        amount[np.cumsum(times) - 1] = seen[1] - most * (times - 1)
        pairs = np.stack([place % width, amount], axis=1).astype("uint16")
        edges = np.searchsorted(place, np.arange(_FAN + 1) * width)
        parts = np.flatnonzero(np.diff(edges)).tolist()
        rows = [pairs[edges[p] : edges[p + 1]].tobytes() for p in parts]
        empty = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(rows, pa.binary()), empty, empty, empty], names)

    return docs.mapInArrow(run, "part int, counts binary, set_id long, doc_id long, sub long")


def levels(surveyed: DataFrame) -> tuple[np.ndarray, int]:
    """For each counter 0 if one line at most has a word of it, else about 8 log2 of the number of lines, 255 at most; and the number of words counted.

    Counters are added up part by part on executors; a byte for each counter comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (1 << COUNTER_BITS) // _FAN
        now, total = None, np.zeros(width, dtype="int64")

        def out() -> pa.RecordBatch:
            level = np.where(total > 1, np.clip(np.round(8 * np.log2(np.maximum(total, 1))), 1, 255), 0).astype("uint8")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["part", "level", "n"])

        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, total = part, np.zeros(width, dtype="int64")
                pairs = np.frombuffer(counts, dtype="uint16").reshape(-1, 2).astype("int64")
                total += np.bincount(pairs[:, 0], weights=pairs[:, 1], minlength=width).astype("int64")
        if now is not None:
            yield out()

    counted = surveyed.filter("part is not null").select("part", "counts").repartition("part").sortWithinPartitions("part")
    level, n = np.zeros(1 << COUNTER_BITS, dtype="uint8").reshape(_FAN, -1), 0
    for row in counted.mapInArrow(run, "part int, level binary, n long").collect():
        level[row["part"]] = np.frombuffer(row["level"], dtype="uint8")
        n += row["n"]
    return level.ravel(), n


def divided(docs: DataFrame, level: Broadcast, share: int = 16) -> dict[int, int]:
    """The words with more than about MOST_OF_A_WORD entries and into how many parts each is to be divided. That only deals the
    work, so the entries are counted in a sample of one text in `share`, chosen by its hash; the driver gets a row for each
    MOST_OF_A_WORD entries at most. Only words that as many lines have are looked at."""
    most = MOST_OF_A_WORD
    least = int(8 * np.log2(max(most, 2)))
    if not (level.value >= least).any():
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = _New()
        for sets in _sets(batches, level.value):
            at = sets.prefixes(new(sets))
            word, n = np.unique(sets.word[at[sets.rank[at] >= least]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view("int64")), pa.array(n)], ["token", "n"])

    some = docs.filter(F.col("h") % share == 0)
    counted = some.mapInArrow(run, "token long, n long").groupBy("token").agg((F.sum("n") * share).alias("n")).filter(F.col("n") > most)
    return {r["token"]: -(-r["n"] // most) for r in counted.collect()}


def _planes(a: np.ndarray) -> bytes:
    """Whole numbers of 0 and more by their bytes: first how many, then the lowest byte of all numbers, the next, ..."""
    a = a.astype("uint64")
    n = -(-int(a.max()).bit_length() // 8) if len(a) else 0
    return bytes([n]) + np.ascontiguousarray(a.view("uint8").reshape(-1, 8)[:, :n].T).tobytes()


def packed(e: dict[str, np.ndarray]) -> bytes:
    """Entries of one part, in the order of their 40-bit words, column by column."""
    order = np.argsort(e["token"], kind="stable")
    e = {c: v[order] for c, v in e.items()}
    least = int(e["doc_id"].min())
    size = e["shape"] >> 32
    columns = [np.diff(e["token"], prepend=0), e["doc_id"].view("uint64") - np.array(least, dtype="int64").view("uint64"), e["sub"].view("uint64"), size, e["shape"] & 0xFFFFFFFF, e["split"], e["p0"].view("uint64")]
    for beyond, names in zip(WIDER, _EXTRA, strict=True):
        columns += [e[c][size > beyond].view("uint64") for c in names]
    return struct.pack("<iq", len(order), least) + b"".join(map(_planes, columns))


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    count, least = struct.unpack_from("<iq", blob)
    at = 12

    def column(n: int) -> np.ndarray:
        nonlocal at
        width = blob[at]
        wide = np.zeros((n, 8), dtype="uint8")
        wide[:, :width] = np.frombuffer(blob, dtype="uint8", count=width * n, offset=at + 1).reshape(width, n).T
        at += 1 + width * n
        return wide.view("int64").ravel()

    token, doc, sub, size, place, split, p0 = (column(count) for _ in range(7))
    out = {"token": np.cumsum(token), "doc_id": doc + least, "sub": sub, "shape": (size << 32) | place, "split": split, "p0": p0}
    for beyond, names in zip(WIDER, _EXTRA, strict=True):
        own = np.flatnonzero(size > beyond)
        for c in names:
            out[c] = np.zeros(count, dtype="int64")
            out[c][own] = column(len(own))
    return out


def packed_entries(docs: DataFrame, level: Broadcast, parts: int, many: dict[int, int]) -> DataFrame:
    """(part, blob): the prefix entries of each line, dealt by their word and, of the words in `many`, by a hash of the line.
    A set that a task meets again is left out there, so a line that most documents share costs one entry a word and task."""
    hot = np.array(sorted(many), dtype="int64")
    pieces = np.array([many[k] for k in hot.tolist()], dtype="uint64")

    def blobs(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        e = {c: np.concatenate([h[c] for h in held]) for c in _ENTRY}
        word = e["token"].view("uint64")
        split = np.zeros(len(word), dtype="int64")
        salt = np.zeros(len(word), dtype="uint64")
        if len(hot):
            at = np.minimum(np.searchsorted(hot, e["token"]), len(hot) - 1)
            own = hot[at] == e["token"]
            split[own] = 1
            salt[own] = mix(e["sub"].view("uint64")[own] ^ mix(e["doc_id"].view("uint64")[own])) % pieces[at[own]] + np.uint64(1)
        part = (mix((word >> np.uint64(40)) + (salt << np.uint64(24))) % np.uint64(parts)).astype("int64")
        e |= {"token": (word & np.uint64((1 << 40) - 1)).astype("int64"), "split": split}
        order = np.argsort(part, kind="stable")
        part = part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out = [packed({c: v[order[a:b]] for c, v in e.items()}) for a, b in zip(edges, [*edges[1:], len(part)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edges], pa.int64()), pa.array(out, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, held, n = _New(), [], 0
        for sets in _sets(batches, level.value):
            at = sets.prefixes(new(sets))
            if len(at):
                held.append(sets.entries(at))
                n += len(at)
            if n > 1 << 19:
                yield blobs(held)
                held, n = [], 0
        if held:
            yield blobs(held)

    return docs.mapInArrow(run, "part long, blob binary")


def _near(run: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) of entries of one word pass all filters, and their unlike bits. By place: what comes before the
    word isn't shared. By parity: the symmetric difference is at most a ninth of both sizes; first by 64 places, then, where
    both lines have them, by 128, 256 and 512."""
    size, place = run["shape"] >> 32, run["shape"] & 0xFFFFFFFF
    a, b = size[i], size[j]
    ok = np.flatnonzero((5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * (1 + np.minimum(a - 1 - place[i], b - 1 - place[j])) >= 4 * (a + b)))
    # the wider parities lie in the order that the entries came in
    differ = lambda c: (run[c][run["came"][i[ok]]] ^ run[c][run["came"][j[ok]]]).view("uint64")
    ones = lambda parts: sum(np.bitwise_count(p).astype("int64") for p in parts)
    parts = [(run["p0"][i[ok]] ^ run["p0"][j[ok]]).view("uint64")]
    unlike = ones(parts)
    for beyond, names in zip(WIDER, _EXTRA, strict=True):
        good = 9 * unlike <= (a + b)[ok]
        ok, unlike, parts = ok[good], unlike[good], [p[good] for p in parts]
        firsts = [differ(c) for c in names]
        parts = firsts + [p ^ f for p, f in zip(parts, firsts, strict=True)]
        unlike = np.where((a[ok] > beyond) & (b[ok] > beyond), ones(parts), unlike)
    good = 9 * unlike <= (a + b)[ok]
    return ok[good], unlike[good]


def _earlier(run: dict[str, np.ndarray], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    doc, sub = run["doc_id"], run["sub"]
    return (doc[y] < doc[x]) | ((doc[y] == doc[x]) & (sub[y] < sub[x]))


def _by_word(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The entries in the order of their words and sizes (`came`: where each one was), and where each word begins."""
    token, size = rows["token"], rows["shape"] >> 32
    if token.min() >= 0 and token.max() < 1 << 42 and size.max() < 1 << 20:
        order = np.argsort((token << 20) | size)
    else:
        order = np.lexsort((size, token))
    run = {c: v if c in _PARITY[1:] else v[order] for c, v in rows.items()} | {"came": order}
    return run, np.concatenate([[0], np.flatnonzero(run["token"][1:] != run["token"][:-1]) + 1, [len(order)]])


def _stars(run: dict[str, np.ndarray], edges: np.ndarray, large: int = 512, most: int = 16) -> tuple[np.ndarray, ...]:
    """(x, y, unlike): in each large run of one word, lines that clearly match one of its first lines. A group of near copies is
    settled by its first member, so its pairs needn't be looked at."""
    found = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a <= large:
            continue
        left = a + np.lexsort((run["sub"][a:b], run["doc_id"][a:b]))
        for _ in range(most):
            pivot, left = left[:1], left[1:]
            near, unlike = _near(run, left, np.broadcast_to(pivot, left.shape))
            size = run["shape"][left[near]] + run["shape"][pivot] >> 32
            clear = (18 * unlike <= size) & _earlier(run, np.broadcast_to(pivot, near.shape), left[near])
            near, unlike = near[clear], unlike[clear]
            found.append((left[near], np.broadcast_to(pivot, near.shape), unlike))
            if 20 * len(near) < len(left) or len(near) == len(left):
                break
            left = np.delete(left, near)
    return tuple(np.concatenate(f) if found else np.empty(0, dtype="int64") for f in (zip(*found, strict=True) if found else ((),) * 3))


def _pairs(run: dict[str, np.ndarray], xs: np.ndarray, edges: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, unlike): entries `xs` and, of the same word, those of earlier lines that pass all filters. `run` is ordered by
    (token, size), so partners lie between 4 / 5 and 5 / 4 of the size. At most about `most` pairs are looked at together."""
    size = run["shape"] >> 32
    group = (np.repeat(np.arange(len(edges) - 1), np.diff(edges)) << 32) | size
    own = group[xs] >> 32 << 32
    low = np.searchsorted(group, own | -(-size[xs] * 4 // 5), "left")
    high = np.searchsorted(group, own | np.minimum(size[xs] * 5 // 4, (1 << 32) - 1), "right")
    width = high - low
    total = np.concatenate([[0], np.cumsum(width)])
    at = 0
    while at < len(xs):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        n = width[at:to]
        x = np.repeat(xs[at:to], n)
        y = np.arange(len(x)) + np.repeat(low[at:to] - (total[at:to] - total[at]), n)
        before = _earlier(run, y, x)
        x, y = x[before], y[before]
        near, unlike = _near(run, x, y)
        yield x[near], y[near], unlike
        at = to


def _likest(f: dict[str, np.ndarray], limit: int, clear: int) -> dict[str, np.ndarray]:
    """The `limit` likest different candidates of each line, or `clear` where the likest is a clear one, with more = 1 where there
    are others."""
    order = np.lexsort((f["y_sub"], f["y_doc"], f["unlike"], f["x_sub"], f["x_doc"]))
    f = {c: v[order] for c, v in f.items()}
    x_new = np.concatenate([[True], (f["x_doc"][1:] != f["x_doc"][:-1]) | (f["x_sub"][1:] != f["x_sub"][:-1])])
    new = x_new | np.concatenate([[True], (f["y_doc"][1:] != f["y_doc"][:-1]) | (f["y_sub"][1:] != f["y_sub"][:-1])])
    at = np.flatnonzero(x_new)
    more = np.maximum.reduceat(f["more"], at)
    f = {c: v[new] for c, v in f.items()}
    at = np.flatnonzero(x_new[new])
    group = np.cumsum(x_new[new]) - 1
    nth = np.arange(len(group)) - at[group]
    most = np.where(f["clear"][at], clear, limit)[group]
    f["more"] = np.maximum(more, np.maximum.reduceat((nth >= most).astype("int64"), at))[group]
    return {c: v[nth < most] for c, v in f.items()}


def _best(rows: dict[str, np.ndarray], limit: int, clear: int) -> pa.RecordBatch | None:
    """`_likest` of the entries `rows`; more = 1 also where a divided word leaves others open (then even without any candidate:
    y null)."""
    rows, edges = _by_word(rows)
    n = len(rows["token"])
    size = rows["shape"] >> 32
    held: list[dict[str, np.ndarray]] = []

    def add(x: np.ndarray, y: np.ndarray, unlike: np.ndarray, more: int) -> None:
        held.append({"x_doc": rows["doc_id"][x], "x_sub": rows["sub"][x], "unlike": unlike, "y_doc": rows["doc_id"][y], "y_sub": rows["sub"][y], "more": np.full(len(x), more), "clear": 18 * unlike <= size[x] + size[y]})
        if sum(len(h["more"]) for h in held) > 1 << 20:
            held[:] = [_likest({c: np.concatenate([h[c] for h in held]) for c in held[0]}, limit, clear)]

    if "probe" in rows:
        xs = np.flatnonzero(rows["probe"])
    else:
        x, y, unlike = _stars(rows, edges)
        add(x, y, unlike, 1)
        settled = np.zeros(n, dtype=bool)
        settled[x] = True
        xs = np.flatnonzero(~settled)
    for x, y, unlike in _pairs(rows, xs, edges):
        add(x, y, unlike, 0)
    if "split" in rows:
        x = np.flatnonzero(rows["split"])
        add(x, x, np.full(len(x), 1 << 40), 1)
    if not any(len(h["more"]) for h in held):
        return None
    f = _likest({c: np.concatenate([h[c] for h in held]) for c in held[0]}, limit, clear)
    nothing = f["unlike"] == 1 << 40
    return pa.RecordBatch.from_arrays([pa.array(f[c], pa.int64(), mask=nothing if c in ("y_doc", "y_sub") else None) for c in _FOUND], list(_FOUND))


def _by_line(found: DataFrame, limit: int) -> DataFrame:
    """(x_doc, x_sub, ys, more): the `limit` likest candidates over all words of each line."""
    several = found.groupBy("x_doc", "x_sub").agg(F.collect_set(F.when(F.col("y_doc").isNotNull(), F.struct("unlike", "y_doc", "y_sub"))).alias("_ys"), F.max("more").alias("more"))
    return several.select("x_doc", "x_sub", F.slice(F.array_sort("_ys"), 1, limit).alias("ys"), F.greatest("more", (F.size("_ys") > limit).cast("long")).alias("more"))


_FOUND_SCHEMA = ", ".join(f"{c} long" for c in _FOUND)


def candidates(entries: DataFrame, limit: int, clear: int) -> DataFrame:
    """`_by_line` of `packed_entries`: each part is read as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            parts = list(map(unpacked, held))
            if got := _best({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, limit, clear):
                yield got

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if part != now and held:
                    yield from out()
                    held = []
                now = part
                held.append(blob)
        if held:
            yield from out()

    return _by_line(entries.mapInArrow(run, _FOUND_SCHEMA), limit)


def _names(doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), dtype=[("doc", "int64"), ("sub", "int64")])
    out["doc"], out["sub"] = doc, sub
    return out


def _among(doc: np.ndarray, sub: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which lines are in the sorted `names`."""
    out = np.zeros(len(doc), dtype=bool)
    if len(names) and len(doc):
        a, b = np.searchsorted(names["doc"], doc, "left"), np.searchsorted(names["doc"], doc, "right")
        for i in np.flatnonzero(b > a).tolist():
            own = names["sub"][a[i] : b[i]]
            k = int(np.searchsorted(own, sub[i]))
            out[i] = k < len(own) and own[k] == sub[i]
    return out


def _shared(names: DataFrame) -> Broadcast | None:
    """(doc, sub) of `names`, sorted and broadcast; None beyond MOST_BROADCAST."""
    if names.count() > MOST_BROADCAST:
        return None
    got = names.toArrow()
    out = _names(*(got.column(i).to_numpy() for i in (0, 1)))
    return names.sparkSession.sparkContext.broadcast(np.sort(out, order=["doc", "sub"]))


_MEMBER = (*_ENTRY, "probe")
_MEMBER_SCHEMA = ", ".join(f"{c} long" for c in _MEMBER) + ", words binary"


def _with_words(sets: Sets, at: np.ndarray, probe: int) -> pa.RecordBatch:
    e = sets.entries(at) | {"probe": np.full(len(at), probe)}
    own = sets.line[at]
    lists = [sets.word[a:b].tobytes() for a, b in zip(sets.start[own].tolist(), sets.start[own + 1].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([*(pa.array(e[c]) for c in _MEMBER), pa.array(lists, pa.binary())], [*_MEMBER, "words"])


def _matches(rows: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Of the entries of one or more words those with probe = 1 whose lines match an earlier one among the others."""
    rows, edges = _by_word(rows)
    order = rows["came"]
    found: set[int] = set()
    for x, y, _ in _pairs(rows, np.flatnonzero(rows["probe"]), edges):
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if a not in found:
                s, t = (np.frombuffer(words[order[i]], "uint64") for i in (a, b))
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 5 * both >= 4 * (len(s) + len(t) - both):
                    found.add(a)
    return order[sorted(found)]


def matched_at_last(docs: DataFrame, level: Broadcast, again: DataFrame, words: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """(x_doc, x_sub) of the lines `again` that match an earlier one, each met with the sets of all lines that share a prefix
    word, whatever their number. words: (doc_id, sub, words) of these lines at least."""
    spark = docs.sparkSession
    own = words.join(again.select(F.col("x_doc").alias("doc_id"), F.col("x_sub").alias("sub")), ["doc_id", "sub"], "left_semi")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(w, "uint64") for w in batch.column("words").to_pylist()]
            n = len(lists)
            doc, sub = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "sub"))
            start = np.concatenate([[0], np.cumsum([len(w) for w in lists], dtype="int64")]).astype("int64")
            block = Block(np.arange(n), sub & 0xFFFFFFFF, start, np.concatenate(lists) if n else np.empty(0, "uint64"))
            sets = Sets(doc, sub.view("uint64") >> np.uint64(32), block, level.value)
            yield _with_words(sets, sets.prefixes(np.ones(n, dtype=bool)), 1)

    probes = cut(own.mapInArrow(ask, _MEMBER_SCHEMA))
    tokens = cut(probes.select("token").distinct())
    few = tokens.count() <= MOST_BROADCAST
    wanted = spark.sparkContext.broadcast(np.sort(tokens.toArrow().column(0).to_numpy())) if few else None

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, counters = _New(), None
        if few:
            counters = np.zeros(1 << COUNTER_BITS, dtype=bool)
            counters[_counter(wanted.value.view("uint64"))] = True
        for sets in _sets(batches, level.value, counters=counters):
            at = sets.prefixes(new(sets))
            yield _with_words(sets, at[np.isin(sets.word[at].view("int64"), wanted.value)] if few else at, 0)

    members = docs.mapInArrow(answer, _MEMBER_SCHEMA)
    members = stored(members if few else members.join(tokens.hint("merge"), "token", "left_semi"))
    pieces = cut(members.groupBy("token").count().select("token", F.ceil(F.col("count") / piece).cast("long").alias("pieces")).filter("pieces > 1"))
    of = lambda df: df.join(F.broadcast(pieces) if pieces.count() <= MOST_BROADCAST else pieces.hint("merge"), "token", "left")
    salted = of(members).withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id", "sub"), "pieces"), F.lit(0).cast("long")))
    asking = of(probes).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1).cast("long")) - 1)))
    columns = [*_MEMBER, "words", "piece"]
    met = salted.select(*columns).unionByName(asking.select(*columns)).repartition("token", "piece").sortWithinPartitions("token", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            rows = {c: t.column(c).to_numpy() for c in _MEMBER}
            at = _matches(rows, t.column("words").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(rows["doc_id"][at]), pa.array(rows["sub"][at])], ["x_doc", "x_sub"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                token, part = (some.column(c).to_numpy(zero_copy_only=False) for c in ("token", "piece"))
                edges = [0, *(np.flatnonzero((np.diff(token) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(token)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if held and (held[0].column("token")[0].as_py(), held[0].column("piece")[0].as_py()) != (int(token[a]), int(part[a])):
                        yield out()
                        held = []
                    held.append(some.slice(a, b - a))
        if held:
            yield out()

    return met.mapInArrow(run, "x_doc long, x_sub long").distinct()


def words_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, sub, words): the sorted word hashes of the lines `names` (doc_id, sub)."""
    shared = _shared(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets(batches, None, names=shared.value if shared is not None else None):
            lists = [sets.word[a:b].tobytes() for a, b in zip(sets.start[:-1].tolist(), sets.start[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sets.doc), pa.array(sets.sub), pa.array(lists, pa.binary())], ["doc_id", "sub", "words"])

    out = docs.mapInArrow(run, "doc_id long, sub long, words binary")
    return (out if shared is not None else out.join(names.hint("merge"), ["doc_id", "sub"], "left_semi")).dropDuplicates(["doc_id", "sub"])


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(x_doc, x_sub) of the lines that have a Jaccard similarity of at least 4 / 5 with a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("wx").to_pylist(), batch.column("wy").to_pylist(), strict=True):
                a, b = np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64")
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(5 * both >= 4 * (len(a) + len(b) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["x_doc", "x_sub"])

    of = lambda side: words.select(F.col("doc_id").alias(f"{side}_doc"), F.col("sub").alias(f"{side}_sub"), F.col("words").alias(f"w{side}"))
    joined = pairs.join(of("y"), ["y_doc", "y_sub"]).join(of("x"), ["x_doc", "x_sub"])
    return joined.select("x_doc", "x_sub", "wx", "wy").mapInArrow(run, "x_doc long, x_sub long").distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, sub) of the lines with words that no earlier line matches. docs: (doc_id, h, text), distinct, without nulls."""
    spark = docs.sparkSession
    found = stored(survey(docs))
    level, n = levels(found)
    shared = spark.sparkContext.broadcast(level)
    place = F.struct("doc_id", "sub")
    firsts = found.filter("part is null").groupBy("set_id").agg(F.min(place).alias("p"))
    firsts = stored(firsts.select("p.doc_id", "p.sub"))
    parts = max(1, -(-n // (4 * PART)))
    entries = packed_entries(docs, shared, parts, divided(docs, shared))
    dealt = entries.repartition(min(parts, 1 << 15), "part").sortWithinPartitions("part")
    # equal sets need no candidates: all but their first line go
    found = candidates(dealt, FIRST_CANDIDATES, CLEAR_CANDIDATES)
    found = cut(found.join(firsts.select(F.col("doc_id").alias("x_doc"), F.col("sub").alias("x_sub")), ["x_doc", "x_sub"], "left_semi"))
    pairs = cut(found.select("x_doc", "x_sub", F.explode("ys").alias("y")).select("x_doc", "x_sub", "y.y_doc", "y.y_sub"))
    x, y = ([F.col(f"{side}_doc").alias("doc_id"), F.col(f"{side}_sub").alias("sub")] for side in "xy")
    words = cut(words_of(docs, cut(found.select(*x).union(pairs.select(*y)).distinct())))
    matched = cut(verified(pairs, words))
    again = cut(found.filter("more = 1").select("x_doc", "x_sub").join(matched, ["x_doc", "x_sub"], "left_anti"))
    if not again.isEmpty():
        matched = matched.union(cut(matched_at_last(docs, shared, again, words)))
    return firsts.join(matched.select(*x), ["doc_id", "sub"], "left_anti")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text for each row of `docs` (doc_id, text): lines that match an earlier one are gone.

    Lines end at newlines; words are what ASCII white space divides, A-Z lower-cased. Lines without words stay. A null text
    stays null with 0 lines; an empty text is one line. A row with a null doc_id takes no part and keeps its text. Rows that
    share a doc_id are documents of their own, in the order of a hash of their texts; of rows that are equal in doc_id and
    text one is the first. A text of any length is read whole, in blocks.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    taking = F.col("_id").isNotNull() & F.col("text").isNotNull()
    rows = docs.select("doc_id", "text").withColumn("_id", F.col("doc_id").cast("long")).withColumn("_h", F.when(taking, F.xxhash64("text").bitwiseAND(0xFFFFFFFF)))
    texts = rows.filter(taking).select(F.col("_id").alias("doc_id"), F.col("_h").alias("h"), "text")
    kept = kept_lines(texts).withColumn("h", F.shiftrightunsigned("sub", 32)).groupBy("doc_id", "h").agg(F.collect_list(F.col("sub").bitwiseAND(0xFFFFFFFF)).alias("_kept"))
    # rows equal in id and hash: one of them keeps the lines
    repeated = cut(texts.groupBy("doc_id", "h").count().filter("count > 1"))
    repeats = repeated.count()
    every = rows.filter(taking).withColumn("_copy", F.lit(0).cast("long"))
    if repeats:
        mark = repeated.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("count").alias("_n"))
        marked = rows.filter(taking).join(F.broadcast(mark) if repeats <= MOST_BROADCAST else mark, ["_id", "_h"], "left")
        once = marked.filter("_n is not null").dropDuplicates(["_id", "_h"]).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        every = marked.filter("_n is null").withColumn("_copy", F.lit(0).cast("long")).unionByName(once).drop("_n")
    joined = every.join(kept.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h"), ["_id", "_h"], "left")
    joined = joined.unionByName(rows.filter(~taking).withColumn("_copy", F.lit(0).cast("long")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.split_pattern(batch.column("text"), "\n")
            n = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(n)])
            flat = pc.list_flatten(lines)
            stay = pc.equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
            stay |= np.repeat(batch.column("_id").is_null().to_numpy(zero_copy_only=False), n)
            chosen = pc.fill_null(pc.list_value_length(batch.column("_kept")), 0).to_numpy(zero_copy_only=False)
            own = np.repeat(batch.column("_copy").to_numpy(zero_copy_only=False) == 0, chosen)
            stay[(np.repeat(start[:-1], chosen) + pc.list_flatten(batch.column("_kept")).to_numpy(zero_copy_only=False))[own]] = True
            left = np.concatenate([[0], np.cumsum(stay)])[start]
            texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), flat.filter(pa.array(stay))), "\n")
            texts = pc.if_else(batch.column("text").is_null(), pa.scalar(None, texts.type), texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(left), pa.int64()), texts.cast(pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    return joined.select("doc_id", "_id", "text", "_kept", "_copy").mapInArrow(run, f"doc_id {kind}, n_lines long, n_removed long, text string")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, list[int]]:
    """doc_id to the removed lines, by comparing every line with every earlier one. For tests on small tables."""
    lines = [(d, i, frozenset(x.encode().lower().split())) for d, t in sorted(rows, key=lambda r: r[0]) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    out: dict[int, list[int]] = {}
    for j, (d, i, s) in enumerate(lines):
        if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:j]):
            out.setdefault(d, []).append(i)
    return out
