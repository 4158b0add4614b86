"""Whole-batch tokenising and hashing of UTF-8 texts with NumPy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_Q = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Separates runs of ASCII letters and digits and of all other characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Q**i and Q**-i modulo 2**64 for i < n."""
    if len(_pow[0]) < n:
        inverse = pow(_Q, -1, 2**64)
        for k, q in enumerate((_Q, inverse)):
            a = np.full(n, q, U)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def released(run: Callable) -> Callable:
    """run, a function of batches, that gives memory back at its end: idle workers of a stage lie beside the next one's."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """T with T[e] - T[s] = sum of value(buf[i]) * Q**i for s <= i < e."""
    q, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * q[: len(buf)], out=out[1:])
    return out


def span_hash(t: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each buf[s:e]."""
    _, inv = powers(len(t))
    return mix((t[e] - t[s]) * inv[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def blocks(col: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in them) for runs of rows of about limit bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, len(col))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, [^\\x20\\x09-\\x0D]+ by default; words don't cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs[offs <= len(buf)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def shingle_sets(wh: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct hashes of k consecutive words; of all its words, if fewer."""
    at = np.searchsorted(row, np.arange(n_rows + 1))
    mult = mix(np.arange(1, k + 1, dtype=U)) | U(1)
    n = len(wh) - k + 1
    sh = np.zeros(0, U)
    if n > 0:
        sh = np.zeros(n, U)
        for i in range(k):
            sh += wh[i : i + n] * mult[i]
        sh = mix(sh)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(sh[a : b - k + 1]))
        elif b > a:
            out.append(mix((wh[a:b] * mult[: b - a]).sum(keepdims=True, dtype=U) + U(b - a)))
        else:
            out.append(sh[:0])
    return out
