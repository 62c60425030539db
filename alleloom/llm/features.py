"""Hashed character and word features of whole texts, for the two text classifiers."""

from __future__ import annotations

import numpy as np

from alleloom.llm.common import mix, windows, words

_FOLD = np.arange(0x10000, dtype=np.uint32)
for _i in range(0x10000):
    _c = chr(_i).lower()
    if len(_c) == 1:
        _FOLD[_i] = ord(_c)
_ALPHA = np.array([chr(i).isalpha() for i in range(0x10000)])
_A = np.uint32(0x85EBCA6B)
_B = np.uint32(0xC2B2AE35)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the rows' offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, begins[offsets]


def has_letter(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter; points beyond the basic plane are looked up one by one."""
    low = points < 0x10000
    letter = np.zeros(len(points), bool)
    letter[low] = _ALPHA[points[low]]
    for i in np.flatnonzero(~low):
        letter[i] = chr(points[i]).isalpha()
    seen = np.concatenate([[0], np.cumsum(letter)])
    return seen[offsets[1:]] > seen[offsets[:-1]]


def grams(points: np.ndarray, sizes: tuple[int, ...], slots: int, fold: bool = True) -> list[np.ndarray]:
    """For each n: the slot of the n-gram at each position (the last n - 1 positions of a row reach over its end)."""
    p = points
    if fold:
        p = points.copy()
        low = p < 0x10000
        p[low] = _FOLD[p[low]]
    out = []
    for n in sizes:
        m = max(0, len(p) - n + 1)
        h = np.full(m, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
        for k in range(n):
            h = (h ^ p[k : k + m]) * _A
            h ^= h >> np.uint32(15)
        h *= _B
        h ^= h >> np.uint32(16)
        out.append(h & np.uint32(slots - 1))
    return out


def word_slots(data: np.ndarray, offsets: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of every word, and of every two words in a row of a text."""
    row, _, _, h = words(data, offsets)
    two, ok = windows(row, h, 2)
    slot = lambda x: (mix(x) & np.uint64(slots - 1)).astype(np.uint32)
    return [(row, slot(h)), (row[: len(ok)][ok], slot(two[ok]))]
