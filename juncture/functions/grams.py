"""In how many texts of either class each n-gram of words occurs.

Texts are read chunk by chunk as arrays of bytes: words, n-grams and their counts in a chunk are whole-array operations on exact
codes. A chunk's n-grams are dealt over buckets by a hash and go through one shuffle as a row a bucket, not a row an n-gram; then
the n-grams of a bucket are added up. No task keeps a map of all the n-grams that it meets, so none spills one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts counted together (a longer text is a chunk of its own), bits of a bucket's number, and bytes of whole buckets
#: from which they are added up together.
CHUNK, BITS, TOGETHER = 1 << 19, 12, 1 << 20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_'-")] = True
_DEALT = "bucket int, phrases binary, sizes binary, pos binary, neg binary"
_NAMES = ["bucket", "phrases", "sizes", "pos", "neg"]


def counted(df: DataFrame, low: int, high: int) -> DataFrame:
    """phrase, pos, neg of df (positive, text; neither null, text lower-cased): each text counts an n-gram once, of low to high words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positive = batch.column(0).to_numpy(zero_copy_only=False)
            for data, cuts, i in _chunks(batch.column(1)):
                yield from _dealt(data, cuts, positive[i : i + len(cuts) - 1], low, high)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_buckets(batches):
            yield from _added(held)

    dealt = df.select("positive", "text").mapInArrow(deal, _DEALT)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "phrase string, pos long, neg long")


def occurring(df: DataFrame, phrases: list[str]) -> DataFrame:
    """id, texts: in how many texts of df (text, not null and lower-cased) each of these n-grams occurs, by its place in `phrases`.

    Each task keeps one count a phrase; nothing else of a text goes into the shuffle."""
    tree = Tree.of(phrases)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(phrases), np.int64)
        for batch in batches:
            for data, cuts, _ in _chunks(batch.column(0)):
                total += np.bincount(tree.found(data, cuts), minlength=len(phrases))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "texts"])

    return df.select("text").mapInArrow(count, "id int, texts long").groupBy("id").agg(F.sum("texts").alias("texts"))


@dataclass
class Tree:
    """n-grams by their beginnings. vocabulary: their words; keys: for two words and more the sorted codes (that of the words
    before the last, the last one's place), whose places are the codes of the next length; ids: by length the n-gram of a code, or -1."""

    vocabulary: pa.Array
    keys: list[np.ndarray]
    ids: list[np.ndarray]

    @classmethod
    def of(cls, phrases: list[str]) -> Tree:
        parts = [p.split(" ") for p in phrases]
        words = sorted({w for x in parts for w in x})
        place = {w: i for i, w in enumerate(words)}
        size = np.array([len(x) for x in parts], np.int64)
        code, keys, ids = np.array([place[x[0]] for x in parts], np.int64), [], []
        for n in range(1, int(size.max(initial=1)) + 1):
            many = len(words)
            if n > 1:
                longer = np.flatnonzero(size >= n)
                known, at = np.unique(code[longer] * len(words) + np.array([place[parts[i][n - 1]] for i in longer], np.int64), return_inverse=True)
                code[longer], many = at, len(known)
                keys.append(known)
            named = np.full(many, -1, np.int64)
            named[code[size == n]] = np.flatnonzero(size == n)
            ids.append(named)
        return cls(pa.array([w.encode() for w in words], pa.large_binary()), keys, ids)

    def found(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The n-grams that occur in these texts, each once a text."""
        got = _split(data, cuts)
        if got is None or not len(self.vocabulary):
            return np.empty(0, np.int64)
        _, _, _, doc, words, different = got
        word = pc.fill_null(pc.index_in(different, self.vocabulary), -1).to_numpy().astype(np.int64)[words]
        at = np.flatnonzero(word >= 0)
        code, pairs, many = word[at], [], sum(int((x >= 0).sum()) for x in self.ids)
        for n, named in enumerate(self.ids, 1):
            if n > 1:
                inside = at + n - 1 < len(word)
                at, code = at[inside], code[inside]
                inside = (doc[at] == doc[at + n - 1]) & (word[at + n - 1] >= 0)
                at, code = at[inside], code[inside]
                key = code * len(self.vocabulary) + word[at + n - 1]
                code = np.searchsorted(self.keys[n - 2], key)
                inside = self.keys[n - 2][np.minimum(code, len(self.keys[n - 2]) - 1)] == key
                at, code = at[inside], code[inside]
            known = named[code]
            pairs.append((doc[at] * many + known)[known >= 0])
        return pc.unique(pa.array(np.concatenate(pairs))).to_numpy() % many


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The bytes of about CHUNK of texts, where each begins and the last one ends, and the first one's place."""
    data, cuts = _bytes(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + CHUNK, side="right")) - 1)
        yield data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], i
        i = j


def _bytes(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary array, and where each value begins and the last one ends."""
    if not len(held):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    held = held.cast(pa.large_binary())
    _, cuts, data = held.buffers()
    cuts = np.frombuffer(cuts, np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if cuts[-1] > cuts[0] else np.empty(0, np.uint8), cuts - cuts[0]


def _array(kind: pa.DataType, cuts: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])


def _ends(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    got = values.dictionary_encode()
    return got.indices.to_numpy().astype(np.int64), got.dictionary


def _split(data: np.ndarray, cuts: np.ndarray) -> tuple | None:
    """Of the words of these texts: their letters end to end, where each ends in them, its size, its text, its code, and the
    different words by code; None if there is no word."""
    inside, edge = _IN_WORD[data], np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return None
    size = np.flatnonzero(stops) + 1 - start
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(np.searchsorted(start, cuts)))
    letters, ends = data[inside], _ends(size)
    return letters, ends, size, doc, *_codes(_array(pa.large_binary(), ends, letters))


def _dealt(data: np.ndarray, cuts: np.ndarray, positive: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that the n-grams of these texts fall into: their bytes end to end, their sizes and counts."""
    got = _split(data, cuts)
    if got is None:
        return
    letters, ends, size, doc, words, different = got
    hashed = np.fromiter(map(crc32, different.to_pylist()), np.uint64, len(different))[words]
    # the words with one space after each: an n-gram is a slice of it
    at = ends[:-1] + np.arange(len(size))
    spaced, space = np.empty(len(letters) + len(size), np.uint8), np.zeros(len(letters) + len(size), bool)
    space[at + size] = True
    spaced[space], spaced[~space] = ord(" "), letters

    code, mixed, found = words, hashed, []
    for n in range(1, high + 1):
        m = len(words) - n + 1
        if m <= 0:
            break
        place = np.flatnonzero(doc[:m] == doc[n - 1 :])
        if not len(place):
            break
        if n == 1:
            here, many = words, len(different)
        else:
            # two n-grams are one if their first n - 1 words have one code, and so has their last
            here, known = _codes(pa.array(code[place] * len(different) + words[place + n - 1]))
            many = len(known)
            code = np.zeros(m, np.int64)
            code[place] = here
            mixed = mixed[:m] * np.uint64(0x9E3779B97F4A7C15) + hashed[n - 1 :]
        if n >= low:
            first = np.empty(many, np.int64)
            first[here[::-1]] = place[::-1]
            pos, neg = _texts(here, doc[place], many, positive)
            last = first + n - 1
            found.append((at[first], at[last] + size[last] - at[first], pos, neg, mixed[first] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)))
    if not found:
        return
    begin, length, pos, neg, bucket = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    begin, length = begin[order], length[order]
    to = _ends(length)
    rows = np.bincount(bucket.astype(np.int64))
    used = np.flatnonzero(rows)
    edges = _ends(rows[used])
    phrases = spaced[np.arange(to[-1]) + np.repeat(begin - to[:-1], length)]
    numbers = [_array(pa.large_binary(), edges * 4, x.astype(np.int32)) for x in (length, pos[order], neg[order])]
    columns = [_array(pa.large_binary(), to[edges], phrases), *numbers]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[c.cast(pa.binary()) for c in columns]], names=_NAMES)


def _texts(codes: np.ndarray, doc: np.ndarray, many: int, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each code the positive texts and the others that have it."""
    again = np.bincount(codes, minlength=many)[codes] > 1
    pairs = pc.unique(pa.array(doc[again] * many + codes[again])).to_numpy()
    codes, doc = np.concatenate([codes[~again], pairs % many]), np.concatenate([doc[~again], pairs // many])
    hit = positive[doc]
    return np.bincount(codes[hit], minlength=many), np.bincount(codes[~hit], minlength=many)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by bucket, cut where a bucket ends, into runs of TOGETHER bytes or more."""
    held, size, last = [], 0, None
    for batch in batches:
        buckets, at = batch.column(0).to_numpy(), 0
        while at < len(buckets):
            if size >= TOGETHER and buckets[at] != last:
                yield held
                held, size = [], 0
            last = buckets[at]
            end = int(np.searchsorted(buckets, last, side="right"))
            held.append(batch.slice(at, end - at))
            size += held[-1].nbytes
            at = end
    if held:
        yield held


def _added(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases, sizes, pos, neg = (np.concatenate([_bytes(b.column(i))[0] for b in held]) for i in range(1, 5))
    sizes, pos, neg = (x.view(np.int32) for x in (sizes, pos, neg))
    codes, different = _codes(_array(pa.large_string(), _ends(sizes), phrases))
    # sums of doubles are exact up to 2^53
    pos, neg = (np.bincount(codes, weights=x, minlength=len(different)).astype(np.int64) for x in (pos, neg))
    out = pa.table({"phrase": different.cast(pa.string()), "pos": pos, "neg": neg})
    yield from out.to_batches(max_chunksize=1 << 16)
