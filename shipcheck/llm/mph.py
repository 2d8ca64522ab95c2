"""A minimal perfect hash of 128-bit keys, in numpy: each key to a place of its own among as many as there are keys.

Keys are thrown into a row of bits; those alone on their bit keep it, the others go on to a next, smaller row.
A key's place is the number of bits set before its own, so the function itself costs some three bits a key."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bits of a row for each key thrown into it; rows before keys that don't part count as equal.
ROOM, MOST_ROWS = 2, 80


class PerfectHash(NamedTuple):
    sizes: np.ndarray  # bits of each row, multiples of 64
    words: np.ndarray  # all rows' bits
    ranks: np.ndarray  # bits set before each word


def _mixed(a: np.ndarray, b: np.ndarray, row: int) -> np.ndarray:
    x = (a ^ np.uint64(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29)) ^ b) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def build(a, b) -> PerfectHash:
    """Of the distinct pairs (a[i], b[i]) of 64-bit integers."""
    a, b, sizes, rows = _unsigned(a), _unsigned(b), [], []
    while len(a):
        if len(rows) == MOST_ROWS:
            raise ValueError("keys of a perfect hash must be distinct")
        size = -(-ROOM * len(a) // 64) * 64
        at = (_mixed(a, b, len(rows)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rows.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        rest = ~alone[at]
        a, b = a[rest], b[rest]
    words = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    ones = np.bitwise_count(words).astype(np.int64)
    return PerfectHash(np.array(sizes, np.int64), words, np.cumsum(ones) - ones)


def places(h: PerfectHash, a, b) -> np.ndarray:
    """The place of each pair; of one that isn't a key, any place or -1."""
    a, b = _unsigned(a), _unsigned(b)
    out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for row, size in enumerate(h.sizes.tolist()):
        if not len(left):
            break
        at = (_mixed(a[left], b[left], row) % np.uint64(size)).astype(np.int64) + base
        word, bit = h.words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit & np.uint64(1)).astype(bool)
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        out[left[hit]] = (h.ranks[at >> 6] + below)[hit]
        left, base = left[~hit], base + size
    return out
