"""Hilbert curve index of integer coordinates (Skilling 2004, transposed form), in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """coords: (n, d) integers in [0, 2**bits); d * bits <= 63.  Returns n curve positions (int64)."""
    x = [c.astype(np.uint64) for c in np.asarray(coords).T]
    d, one = len(x), np.uint64(1)
    zero = np.uint64(0)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, zero, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(x[0]), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[d - 1] & np.uint64(1 << b)) != 0, turn ^ np.uint64((1 << b) - 1), turn)
    x = [c ^ turn for c in x]
    index = np.zeros(len(x[0]), np.uint64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = (index << one) | ((c >> np.uint64(b)) & one)
    return index.astype(np.int64)
