"""Numpy over Arrow text: flat bytes, blocks of bounded size, rolling hashes, runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) into a uint8 array, without a Python object per row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offsets, data = col.buffers()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if offsets is None or not len(col):
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def binary_array(data: bytes | np.ndarray, at: np.ndarray) -> pa.Array:
    """Offsets and bytes as an Arrow binary array."""
    data = data.tobytes() if isinstance(data, np.ndarray) else data
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def groups(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            for k in [k for k in _powers if k < size]:
                del _powers[k]
            up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
            up[0] = down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """h[i] = sum of b[j] * BASE**j for j < i; differences give the hash of any slice."""
    up, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * up[: len(b)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


#: Bytes up to which a slice is hashed with all others at once.
SHORT = 256


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice: eight bytes at a time are mixed in, so no pattern of bytes makes two slices collide; long ones go through BLAKE2."""
    size = end - start
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    with np.errstate(over="ignore"):
        out = mix(size.astype(U) + U(0x51ED270B))
        live, k = np.flatnonzero(size <= SHORT), 0
        while len(live):
            word = words[start[live] + k].view(U).ravel()
            left = np.minimum(size[live] - k, 8).astype(U)
            word &= np.where(left > U(0), ~U(0) >> (U(64) - np.maximum(left, U(1)) * U(8)), U(0))
            out[live] = mix(out[live] * U(0x9FB21C651E98DF25) + word)
            k += 8
            live = live[size[live] > k]
    far = np.flatnonzero(size > SHORT)
    for i in far.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def unlike(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which slices a[i : i + size] and b[j : j + size] differ, as indices."""
    wa, wb = (np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(8, np.uint8)]), 8) for x in (a, b))
    bad, live, k = np.zeros(len(i), bool), np.flatnonzero((size > 0) & (size <= SHORT)), 0
    while len(live):
        gap = wa[i[live] + k].view(U).ravel() ^ wb[j[live] + k].view(U).ravel()
        left = np.minimum(size[live] - k, 8).astype(U)
        bad[live] |= (gap & (~U(0) >> (U(64) - left * U(8)))) != 0
        k += 8
        live = live[size[live] > k]
    for x in np.flatnonzero(size > SHORT).tolist():
        bad[x] = not np.array_equal(a[i[x] : i[x] + size[x]], b[j[x] : j[x] + size[x]])
    return np.flatnonzero(bad)


def sliding(op: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """op over every ``width`` neighbours, in log2(width) passes."""
    have = 1
    while have * 2 <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(counts)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


def heads(*cols: np.ndarray) -> np.ndarray:
    """Where a run of equal tuples begins."""
    n = len(cols[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
