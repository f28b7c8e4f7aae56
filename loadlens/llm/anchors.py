"""Content-defined anchors of byte strings: equal strings of ``LENGTH`` bytes have equal anchors at equal places."""

from __future__ import annotations

import numpy as np

#: Length of the strings whose repeats are sought, and of the byte n-grams that anchor them.
LENGTH, GRAM = 200, 40
#: Positions of n-grams in a string of LENGTH bytes.
SPAN = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte * base^i modulo 2^64, and the inverse powers that make sums of equal strings equal."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    return sums, _powers(_INVERSE, n + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def hashes(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each string from ``start`` to ``end``; its length counts."""
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each window of ``width`` values, by block prefixes and suffixes."""
    n = len(x)
    fill = np.iinfo(np.uint64).max if best is np.minimum else 0
    padded = np.concatenate((x, np.full(-n % width, fill, np.uint64))).reshape(-1, width)
    left = best.accumulate(padded, axis=1).ravel()
    right = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - width + 1], left[width - 1 : n])


def anchors(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and the strings they own: positions, first and last start.

    The anchor of a string of LENGTH bytes is the leftmost of its least n-gram hashes, so every string has one anchor,
    equal strings have it at the same place, and an anchor's strings start at neighbouring bytes.
    """
    n = len(grams) - SPAN + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    least = _slide(grams, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate((edge, least, edge)), SPAN, np.maximum) == grams)
    owner = np.searchsorted(places, np.arange(n))
    wrong = np.flatnonzero(grams[places[owner]] != least)
    while len(wrong):
        owner[wrong] += 1
        wrong = wrong[grams[places[owner[wrong]]] != least[wrong]]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return places[owner[first]], first, np.append(first[1:], n) - 1
