"""Language by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest pieces that occur
in a language's text; the language that needs the fewest pieces a byte wins (Ziv and Merhav 1993). The automata are tables,
walked in numpy by all segments of many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import bounded_sample, fold, one_text_each, small_batches

#: ASCII signs, digits and controls are one space; what is beyond ASCII stays.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower case, everything in ASCII but letters as single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


@dataclass(frozen=True)
class Parser:
    """Labelled text by language; what is built of it is kept in each Python worker."""

    texts: tuple[tuple[str, bytes], ...]

    @property
    def languages(self) -> list[str]:
        return [t[0] for t in self.texts]

    def phrases(self, texts: list[bytes], segment: int = 1024) -> np.ndarray:
        """(text, language): pieces of the greedy parse. A parse begins anew every `segment` bytes, for each language alike,
        which adds less than one piece a segment."""
        symbols, table, roots = _tables(self.texts)
        width = len(symbols)
        out = np.zeros((len(texts), len(roots)), dtype="int64")
        parts = [(i, t[a : a + segment]) for i, t in enumerate(texts) for a in range(0, len(t), segment)]
        for start in range(0, len(parts), 8192):
            some = sorted(parts[start : start + 8192], key=lambda p: -len(p[1]))
            owner = np.array([p[0] for p in some])
            sizes = np.array([len(p[1]) for p in some])
            grid = np.zeros((len(some), sizes[0]), dtype="uint8")
            for row, (_, part) in enumerate(some):
                grid[row, : len(part)] = np.frombuffer(part, dtype="uint8")
            codes = np.ascontiguousarray(symbols_of(symbols)[grid].T).astype("int32")
            alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
            state = np.repeat(roots[:, None], len(some), axis=1).astype("int32") * 2
            count = np.ones((len(roots), len(some)), dtype="int32")
            for at in range(sizes[0]):
                n = alive[at]
                step = table[(state[:, :n] >> 1) + codes[at, :n]]
                count[:, :n] += step & 1
                state[:, :n] = step
            np.add.at(out, owner, count.T)
        del width
        return out


def symbols_of(symbols: bytes) -> np.ndarray:
    """Byte to column of the tables; bytes that no language has share the last."""
    out = np.full(256, len(symbols), dtype="int32")
    out[np.frombuffer(symbols, dtype="uint8")] = np.arange(len(symbols))
    return out


@lru_cache(maxsize=2)
def _tables(texts: tuple[tuple[str, bytes], ...]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(symbols, table, roots). An entry is 2 * (row of the next state) + (a new piece begins here)."""
    symbols = bytes(sorted({b for _, t in texts for b in t}))
    columns, width = symbols_of(symbols), len(symbols) + 1
    blocks, roots, offset = [], [], 0
    for _, text in texts:
        states = suffix_automaton(text)
        table = np.full((len(states), width), -1, dtype="int64")
        for s, moves in enumerate(states):
            for c, to in moves.items():
                table[s, columns[c]] = to
        # one row more: the state after a byte that the language doesn't have, a piece of its own
        table = np.concatenate([table, np.full((1, width), -1, dtype="int64")])
        fail = np.where(table[0] >= 0, table[0], len(states))
        missing = table < 0
        begins = missing.copy()
        begins[0] = False  # the first piece is counted from the start
        table = (np.where(missing, fail[None, :], table) + offset) * width * 2 + begins
        blocks.append(table)
        roots.append(offset * width)
        offset += len(states) + 1
    return symbols, np.concatenate(blocks).ravel().astype("int32"), np.array(roots, dtype="int64")


def fair_shares(sizes: list[int], budget: int) -> list[int]:
    """How much of each text is taken: all of the short ones, and of the others equal parts of what these leave."""
    out, left = [0] * len(sizes), budget
    for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - k))
        left -= out[i]
    return out


def train(docs: DataFrame, texts_a_language: int = 60, bytes_a_language: int = 24_000) -> Parser:
    """From documents with (doc_id, text, lang): at most `texts_a_language` texts of each language, and of these at most
    `bytes_a_language` in all, so that a long one doesn't stand for all others."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.xxhash64("doc_id", "lang").alias("doc_id"), F.col("lang").alias("_lang"), F.substring("text", 1, bytes_a_language).alias("text"))
    ids = bounded_sample(known.select("doc_id", "_lang").distinct(), F.col("_lang"), F.col("doc_id"), texts_a_language)
    by: dict[str, list[bytes]] = {}
    for row in sorted(one_text_each(known, ids, "_lang").collect()):
        by.setdefault(row["_lang"], []).append(normal(row["text"]))
    joined = {k: b" ".join(t[:n] for t, n in zip(v, fair_shares([len(t) for t in v], bytes_a_language), strict=True) if n) for k, v in by.items()}
    return Parser(tuple(sorted((k, t) for k, t in joined.items() if t)))


def predict(docs: DataFrame, parser: Parser, sharpness: float = 40.0) -> DataFrame:
    """(doc_id, lang_pred, score) for each row. Without a letter: `und` and 0. Ties go to the language that sorts first.

    score: exp(-sharpness * (rate / least rate - 1)) of the winner, as a share of the sum over languages.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = parser.languages
        for batch in batches:
            texts = batch.column("text").to_pylist()
            has = [bool(t) and any(map(str.isalpha, t)) and bool(names) for t in texts]
            data = [normal(t) if h else b"" for t, h in zip(texts, has, strict=True)]
            pieces = parser.phrases(data) if names else np.zeros((len(texts), 1))
            best = pieces.argmin(axis=1)
            least = np.maximum(pieces.min(axis=1, keepdims=True), 1)
            score = 1 / np.exp(-sharpness * (pieces / least - 1)).sum(axis=1)
            lang = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def languages_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from text and lang of the rows outside the held-out quarter.

    Null text or no letter: `und`, score 0. A null lang teaches nothing; with no labelled text at all every row is `und`.
    Repeated rows are predicted each; a null doc_id is neither held out nor learned from.
    """
    small_batches(docs.sparkSession)
    parser = train(docs.filter(fold("doc_id", 4) != 2))
    found = predict(docs, parser)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
