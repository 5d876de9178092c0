"""Vectorised byte and word kernels over Arrow string columns.

A column is handled as one flat byte buffer with row offsets. Word hashes come from a polynomial prefix
sum taken over short slabs, so memory is bounded whatever the length of a text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SLAB = 1 << 18
LONG_WORD = 4096

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word (in place on a copy)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    up, down = np.full(n, BASE, U), np.full(n, BASE_INV, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal separator-free runs that stay inside one row, and word offsets by row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~SEPARATORS[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offs[1:] > offs[:-1]
    at, to = offs[:-1][full], offs[1:][full] - 1
    first[at], last[to] = word[at], word[to]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; words beyond LONG_WORD bytes are hashed whole by another function."""
    out = np.empty(len(starts), U)
    up, down = powers(SLAB + LONG_WORD)
    long_ones = np.flatnonzero(ends - starts > LONG_WORD)
    k = 0
    while k < len(starts):
        base = starts[k]
        stop = int(np.searchsorted(starts, base + SLAB))
        at, to = starts[k:stop] - base, np.minimum(ends[k:stop] - base, SLAB + LONG_WORD)
        seg = data[base : base + int(to.max())].astype(U)
        seg += U(1 + seed)
        seg *= up[: len(seg)]
        acc = np.zeros(len(seg) + 1, U)
        np.cumsum(seg, out=acc[1:])
        out[k:stop] = (acc[to] - acc[at]) * down[at]
        k = stop
    for j in long_ones:
        out[j] = xxhash.xxh3_64_intdigest(data[starts[j] : ends[j]].tobytes(), seed)
    out += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(out)


SHINGLE_MULT = [U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five consecutive words; entry i covers words i to i + 4."""
    n = len(words) - 4
    if n <= 0:
        return np.zeros(0, U)
    acc = words[:n] * SHINGLE_MULT[0]
    for k in range(1, 5):
        acc += mix(words[k : k + n] * SHINGLE_MULT[k])
    return mix(acc)


def short_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer than five words."""
    return U(xxhash.xxh3_64_intdigest(words.tobytes(), 5 + len(words)))
