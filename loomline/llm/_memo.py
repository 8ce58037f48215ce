"""A worker's memory of what pieces of text encode to, of bounded size."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from ._arrays import U, ranges, unlike


class Growing:
    """An array that grows by doubling."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(more)), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Memo:
    """Pieces by their 64-bit hash, with their bytes and spans of ids; a hit counts only if the bytes agree.

    New keys wait in a small sorted table that is merged into the large one now and then. Full, the memo keeps what it has:
    later pieces are then encoded each time.
    """

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.tables = [(np.zeros(0, U), np.zeros(0, np.int32))] * 2  # the large one and the fresh one: keys, numbers of entries
        self.at, self.start = Growing(np.int64), Growing(np.int64)
        self.size, self.count = Growing(np.int32), Growing(np.int32)
        self.text, self.ids = Growing(np.uint8), Growing(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1)
        for names, entry in self.tables:
            if len(names):
                k = np.minimum(np.searchsorted(names, keys), len(names) - 1)
                hit = names[k] == keys
                out[hit] = entry[k[hit]]
        return out

    def keep(self, keys: np.ndarray, raw: list[bytes], count: np.ndarray, ids: np.ndarray) -> None:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        entry = np.arange(self.at.n, self.at.n + len(keys), dtype=np.int32)
        for column, first, n in ((self.at, self.text.n, size), (self.start, self.ids.n, count)):
            column.add(first + np.cumsum(n) - n)
        self.size.add(size)
        self.count.add(count)
        self.text.add(np.frombuffer(b"".join(raw), np.uint8))
        self.ids.add(ids)
        large, fresh = self.tables
        fresh = _merged(fresh, (keys, entry))
        if len(fresh[0]) > max(20_000, len(large[0]) // 4):
            large, fresh = _merged(large, fresh), (np.zeros(0, U), np.zeros(0, np.int32))
        self.tables = [large, fresh]

    def encode(self, keys: np.ndarray, first: np.ndarray, end: np.ndarray, data: np.ndarray, encode: Callable[[list[bytes], np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per piece) of the pieces data[first:end] with these keys; ``encode`` gets each unknown piece once."""
        names, at, back = np.unique(keys, return_index=True, return_inverse=True)
        size = end - first
        # Pieces under one key that are not the same bytes: the key's first piece keeps it, the others get names of their own.
        odd = np.flatnonzero(size != size[at[back]])
        odd = np.union1d(odd, unlike(data, first, data, first[at[back]], np.minimum(size, size[at[back]])))
        back[odd] = len(names) + np.arange(len(odd))
        names, at = np.append(names, keys[odd]), np.append(at, odd)
        entry = self.find(names)
        entry[len(names) - len(odd) :] = -1
        hit = np.flatnonzero(entry >= 0)
        e = entry[hit]
        same = self.size.data[e] == size[at[hit]]
        entry[hit[~same]] = -2
        hit, e = hit[same], e[same]
        entry[hit[unlike(data, first[at[hit]], self.text.data[: self.text.n], self.at.data[e], size[at[hit]])]] = -2  # another piece has the key
        new = np.flatnonzero(entry < 0)
        start, count, ids = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), self.ids.data[: self.ids.n]
        known = entry >= 0
        start[known], count[known] = self.start.data[entry[known]], self.count.data[entry[known]]
        if len(new):
            raw = data.tobytes()
            pieces = [raw[i:j] for i, j in zip(first[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            got = encode(pieces, names[new])
            count[new] = np.fromiter(map(len, got), np.int64, len(got))
            start[new] = len(ids) + np.cumsum(count[new]) - count[new]
            fresh = np.fromiter(chain.from_iterable(got), np.int32, int(count[new].sum()))
            ids = np.concatenate([ids, fresh])
            if self.at.n + len(new) <= self.most and not len(odd) and (entry[new] == -1).all():
                self.keep(names[new], pieces, count[new], fresh)
        per = count[back]
        return ids[ranges(start[back], per)], per


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    put = np.searchsorted(a[0], b[0])
    return np.insert(a[0], put, b[0]), np.insert(a[1], put, b[1])
