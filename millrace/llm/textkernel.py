"""Vectorised hashing of words and shingles over Arrow string arrays.

Works on UTF-8 bytes without making a Python string a word. Words are runs of bytes that are not separators; A-Z are
lower-cased. A word's hash is a polynomial of its bytes modulo 2**64, mixed; a shingle's is a polynomial of its words'.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time, unless a word is longer.
_STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(spaces: bytes) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[list(spaces)] = True
    return lower, space


WHITE = bytes([32, 9, 10, 11, 12, 13])
#: White space, other control bytes and ASCII punctuation.
WHITE_AND_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


class _Powers:
    """Powers of the base and of its inverse, as many as asked for."""

    up = down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            with np.errstate(over="ignore"):
                f = np.full(max(n, _STEP + 1), U(_BASE))
                f[0] = 1
                g = np.full(len(f), U(_BASE_INVERSE))
                g[0] = 1
                cls.up, cls.down = np.multiply.accumulate(f), np.multiply.accumulate(g)
        return cls.up[:n], cls.down[:n]


@dataclass
class Words:
    """The words of some texts: where each starts and ends in data, its hash, and the first word of each text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> tuple[bytes, ...]:
        """The words i to j - 1, lower-cased."""
        return tuple(bytes(self.data[a:b]).lower() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; a null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, spaces: bytes = WHITE, cuts: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """cuts: given the lower-cased bytes, positions inside words where another word starts."""
    lower, space = _table(spaces)
    raw, off = _buffers(texts)
    data = lower[raw]
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    for at in (off[(off > 0) & (off < len(data))], *([cuts(data)] if cuts else [])):
        starts[at] = inside[at]
        ends[at - 1] = inside[at - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), U)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _STEP, "right")))
            a, b = start[i], end[j - 1]
            up, down = _Powers.get(int(b - a))
            total = np.empty(b - a + 1, U)
            total[0] = 0
            np.cumsum((data[a:b].astype(U) + U(1)) * up, out=total[1:])
            s, e = start[i:j] - a, end[i:j] - a
            hashes[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            i = j
    return Words(data, start, end, hashes, np.searchsorted(start, off))


def _combine(parts: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), U(len(parts)))
        for p in parts:
            out = out * U(0xD1342543DE82EF95) + p
        return mix(out)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text, and the first of each text (one more at the end). A shorter text is one shingle."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], U)
    h = w.hash
    if len(h) >= size:
        # At each word the shingle that starts there; those that run into the next text are left out.
        every = _combine([h[k : len(h) - size + 1 + k] for k in range(size)])
        keep = np.zeros(len(h) + 1, np.int64)
        np.add.at(keep, w.first[:-1][n >= size], 1)
        np.add.at(keep, (w.first[1:] - size + 1)[n >= size], -1)
        taken = every[np.cumsum(keep)[: len(every)] > 0]
        target = np.zeros(first[-1] + 1, np.int64)
        np.add.at(target, first[:-1][n >= size], 1)
        np.add.at(target, first[1:][n >= size], -1)
        out[np.cumsum(target)[:-1] > 0] = taken
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            out[first[:-1][short]] = _combine([h[w.first[:-1][short] + j] for j in range(k)])
    return out, first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][first[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return values[new], total[first]


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many bytes of text each, so that memory stays bounded by the longest text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Gives freed memory back to the system; a Python worker lives on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
