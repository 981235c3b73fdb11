"""Words of whole texts as 64-bit hashes, found in numpy on the bytes of an Arrow column.

Words are what ASCII white space divides, A-Z lower-cased. The hash of a word is a difference of running sums of
(a random number a byte) * (a power of an odd base), divided by the power at its start, then mixed: no Python object is made
for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are hashed in blocks of about so many bytes; a longer text goes in pieces that end at white space.
BLOCK = 1 << 18

_RANDOM = np.random.default_rng(20250301)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a text has asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype="uint64")

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK)
            self.up = np.cumprod(np.full(size, _BASE, dtype="uint64"), dtype="uint64")
            self.down = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), dtype="uint64"), dtype="uint64")
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Block:
    """Lines in the order of the texts. row: the text of each line; line: its number there; start: where its words begin in
    `word` (one more at the end). Lines end at newlines; each text has one line at least."""

    row: np.ndarray
    line: np.ndarray
    start: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, edges: np.ndarray, first_row: int) -> Block:
        """`data`: the bytes of texts that begin and end at `edges`."""
        n = len(data)
        space = _SPACE[data]
        head, tail = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
        head[1:n], tail[: n - 1] = space[: n - 1], space[1:]
        head[edges], tail[edges[edges > 0] - 1] = True, True
        starts, ends = np.flatnonzero(head[:n] & ~space), np.flatnonzero(tail[:n] & ~space) + 1
        up, down = _POWERS.of(n)
        total = np.zeros(n + 1, dtype="uint64")
        np.cumsum(_BYTE[data] * up, out=total[1:])
        word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype("uint64"))
        breaks = np.flatnonzero(data == 10)
        # a line begins at each text and after each newline
        row_of_break = np.searchsorted(edges, breaks, "right") - 1
        begins = np.concatenate([edges[:-1], breaks + 1])
        rows = np.concatenate([np.arange(len(edges) - 1), row_of_break])
        order = np.lexsort((begins, rows))
        begins, rows = begins[order], rows[order]
        line = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        return cls(rows + first_row, line, np.append(np.searchsorted(starts, begins), len(starts)), word)

    def only(self, chosen: np.ndarray) -> Block:
        """The chosen lines."""
        size = np.diff(self.start)
        return Block(self.row[chosen], self.line[chosen], np.concatenate([[0], np.cumsum(size[chosen])]), self.word[np.repeat(chosen, size)])

    def parts(self, most: int) -> Iterator[Block]:
        """Blocks of at most `most` lines."""
        for a in range(0, len(self.row), most):
            b = min(a + most, len(self.row))
            yield Block(self.row[a:b], self.line[a:b], self.start[a : b + 1] - self.start[a], self.word[self.start[a] : self.start[b]])


def _joined(parts: list[Block]) -> Block:
    """Pieces of one text as one block: a piece's first line goes on with the last line of the piece before."""
    start, offset, lines = [parts[0].start[:-1]], len(parts[0].word), len(parts[0].line)
    for p in parts[1:]:
        start.append(p.start[1:-1] + offset)
        offset += len(p.word)
        lines += len(p.line) - 1
    return Block(np.full(lines, parts[0].row[0]), np.arange(lines), np.append(np.concatenate(start), offset), np.concatenate([p.word for p in parts]))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data) and not _SPACE[data[to - 1]]:
            more = np.flatnonzero(_SPACE[data[to : to + BLOCK]])
            to = to + int(more[0]) + 1 if len(more) else min(to + BLOCK, len(data))
        yield data[at:to]
        at = to


def blocks(column: pa.Array) -> Iterator[Block]:
    """The lines of every text of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype="int64" if wide else "int32")[column.offset : column.offset + len(column) + 1].astype("int64")
    data = np.frombuffer(column.buffers()[2] or b"", dtype="uint8")
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        own = data[offsets[at] : offsets[to]]
        if len(own) > BLOCK and to == at + 1:
            yield _joined([Block.of(p, np.array([0, len(p)]), at) for p in _pieces(own)])
        else:
            yield Block.of(own, offsets[at : to + 1] - offsets[at], at)
        at = to
