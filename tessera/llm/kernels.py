"""Vectorised text kernels over Arrow batches: tokens, hashes of tokens and of token windows.

Everything works on the UTF-8 bytes of a block of documents at once, so that a word costs nanoseconds rather than a
Python call. A block holds whole documents of about a megabyte together; one very long document is a block of its own.
Hashes are polynomials modulo 2**64 with an odd base (so that prefix sums give any span), finished by a mixing step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BYTE_BASE, _TOKEN_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory of its arrays back to the system: idle workers stay beside the next stage's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


def spaces_class() -> np.ndarray:
    """Byte classes for words between blanks: 0 for x20 and x09 to x0D, 1 for the rest."""
    table = np.ones(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def words_class() -> np.ndarray:
    """1 for ASCII letters, digits and all bytes of other characters, 0 for the rest."""
    table = np.zeros(256, np.uint8)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = 1
    return table


def words_and_marks_class() -> np.ndarray:
    """As words_class(), with 2 for ASCII punctuation; runs of either class are tokens."""
    table = words_class()
    for b in range(33, 127):
        if not table[b]:
            table[b] = 2
    return table


SPACES, WORDS, MARKS = spaces_class(), words_class(), words_and_marks_class()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * BLOCK_BYTES:  # not kept
            return self._grown(self.base, n), self._grown(self.inverse, n)
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = self._grown(self.base, n), self._grown(self.inverse, n)
        return self.up, self.down

    @staticmethod
    def _grown(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_byte_powers, _token_powers = _Powers(_BYTE_BASE), _Powers(_TOKEN_BASE)
_BYTE_CODES = seeded(256, 77)


@dataclass
class Block:
    """Rows first to last (exclusive) of a batch: their text bytes and the offsets of each row's text in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, size: int = BLOCK_BYTES, lower: bool = False) -> Iterator[Block]:
    """Blocks of whole texts of about that many bytes. A null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, side="right")) - 1)
        part = column.slice(first, last - first)
        if lower:
            part = pc.utf8_lower(part)
        start = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        buffer = part.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[start[0] : start[-1]] if buffer is not None and buffer.size else np.empty(0, np.uint8)
        yield Block(first, last, data, start - start[0])
        first = last


@dataclass
class Tokens:
    """Tokens of a block in order: byte spans, the row (counted in the block) and where each row's tokens begin."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bounds: np.ndarray


def tokenise(block: Block, classes: np.ndarray) -> Tokens:
    """Maximal runs of bytes of one class other than 0; a row's end also ends a run."""
    n_rows = len(block.offsets) - 1
    if not len(block.data):
        z = np.empty(0, np.int64)
        return Tokens(z, z, z, np.zeros(n_rows + 1, np.int64))
    kind = classes[block.data]
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[block.offsets] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] != 0
    start, end = at[:-1][keep], at[1:][keep]
    bounds = np.searchsorted(start, block.offsets)
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    return Tokens(start, end, row, bounds)


def token_hashes(block: Block, tokens: Tokens, codes: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each token's bytes."""
    if not len(tokens.start):
        return np.empty(0, np.uint64)
    up, down = _byte_powers.upto(len(block.data) + 1)
    sums = np.empty(len(block.data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_CODES if codes is None else codes)[block.data] * up[: len(block.data)], out=sums[1:])
    return mix((sums[tokens.end] - sums[tokens.start]) * down[tokens.start] + (tokens.end - tokens.start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive tokens; windows over a row's end are for the caller to drop."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    up, down = _token_powers.upto(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:count]) * down[:count])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
