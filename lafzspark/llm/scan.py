"""Vectorised scanning of Arrow text columns: words and polynomial (Rabin-Karp) hashes over whole texts.

Everything here works on UTF-8 bytes with numpy, a few megabytes at a time, so a worker's memory does not depend
on the size of a partition or of an Arrow batch. One text is never divided.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, powers(base, 1), powers(base, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = powers(self.base, n), powers(inverse(self.base), n)
        return self.up, self.down


class Hasher:
    """Hashes of words and of windows of words, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self) -> None:
        self._bytes, self._words = _Powers(BYTE_BASE), _Powers(WORD_BASE)

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._bytes.get(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, words: np.ndarray, n: int) -> np.ndarray:
        """The hash of words[i:i+n] for each i; callers leave out windows that cross documents."""
        if len(words) < n:
            return np.zeros(0, dtype=np.uint64)
        up, down = self._words.get(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], dtype=np.uint64, out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside gap, none crossing a document's border, and the number
    of words before each document (one more entry than documents)."""
    inside = ~gap[buf]
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    np.subtract(inside[1:].view(np.int8), inside[:-1].view(np.int8), out=edge[1:-1])
    if len(buf):
        edge[0], edge[-1] = inside[0], -int(inside[-1])
    is_start, is_end = edge == 1, edge == -1
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    inner = inner[inside[inner - 1] & inside[inner]] if len(inner) else inner  # a word touches the next document's
    is_start[inner] = is_end[inner] = True
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end)
    return starts, ends, np.searchsorted(starts, offsets)


def give_back() -> None:
    """Return freed memory to the system at a pass's end: workers are kept for later tasks, and with them what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU C library has it
    if trim:
        trim(0)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    return column.cast(pa.large_binary())


def slices(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes together, one row at least."""
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each text in them); nulls count as empty texts."""
    column = as_bytes(column)
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    for a, b in slices(np.diff(offsets), most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
