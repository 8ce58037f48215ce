"""Word shingles of Arrow text, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._arrays import U, groups, hashes, mix, ranges

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.array([3, 5, 7, 11, 13, 17, 19, 23, 29, 31], U) * U(0x9E3779B97F4A7C15)


def words(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row): maximal runs of bytes that are not ASCII white space; none crosses a row's end."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.append(False, solid[:-1]) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.append(solid[1:], False) if len(data) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


_ANY, _LETTER, _DIGIT, _SIGN, _QUOTE, _GAP, _SOLID = range(7)
_KIND = np.full(256, _ANY, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A], _KIND[0x27], _KIND[[9, 10, 13, 32]] = _DIGIT, _QUOTE, _GAP
_ENDS = np.zeros((8, 8), bool)
_ENDS[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = _ENDS[_DIGIT, [_LETTER, _SIGN, _QUOTE]] = _ENDS[_SIGN, [_LETTER, _DIGIT]] = _ENDS[_QUOTE, _DIGIT] = True
_ENDS[[_LETTER, _DIGIT, _SIGN, _QUOTE, _SOLID], _GAP] = True
_ENDS = _ENDS.ravel()


def seams(data: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Whether a match of letters, digits or other signs must end before each byte and the next begins there, whatever stands around.

    Certain ends only: between ASCII letters, digits and signs (none between an apostrophe and a letter, as in 's, nor after white space), also
    with U+00C0 to U+027F as letters (not the two signs there, nor U+0130, whose lower case ends in a mark), and before ASCII white space. No seam touches a text in ``whole``.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC3)
    first = data[lead]
    lead = lead[(first < 0xE0) | (first >= 0xE4)]  # below U+00C0 and from U+0800 to U+3FFF there is white space
    first = data[lead]
    kind[lead + 1 + (first >= 0xE0) + (first >= 0xF0)] = _SOLID
    lead = lead[first <= 0xC9]
    pair = data[lead].astype(np.uint16) << 8 | data[lead + 1]
    lead = lead[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.append(False, _ENDS[kind[:-1] << 3 | kind[1:]])[: len(data)]
    if whole:
        raw = data.tobytes()
        for text in whole:
            k = raw.find(text)
            while k >= 0:
                cut[k : k + len(text) + 1] = False
                k = raw.find(text, k + 1)
    return cut


def shingles(at: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct run of ``size`` words, in order of row and hash.

    A row of fewer words, but not of none, has one shingle: all its words.
    """
    with np.errstate(over="ignore"):
        start, end, row = words(at, data)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = hashes(data, start, end)
        per = np.bincount(row, minlength=len(at) - 1)
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        count = np.where(per >= size, per - size + 1, (per > 0).astype(np.int64))
        k = ranges(first, count)
        of = np.repeat(np.arange(len(per)), count)
        out = np.zeros(len(k), U)
        for j in range(size):
            inside = j < per[of]
            out += np.where(inside, h[np.minimum(k + j, len(h) - 1)] * _ODD[j], U(0))
        out = mix(out)
        order = np.lexsort((out, of))
        of, out = of[order], out[order]
        keep = np.append(True, (of[1:] != of[:-1]) | (out[1:] != out[:-1]))
        return of[keep], out[keep]


def blocks(at: np.ndarray, data: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j in groups(at, limit):
        yield i, j, at[i : j + 1] - at[i], data[at[i] : at[j]]
