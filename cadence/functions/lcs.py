"""Longest common subsequences of many string pairs at once, bit-parallel in numpy lanes.

Every pair holds one column of the dynamic programme as bits, 64 to a lane: bit j of the state is
0 where the length grows at character j of the second string. One step takes the next character of
all first strings together: u = state & matches, state = (state + u) | (state & ~u), the sum carried
from lane to lane. The loop runs over character positions, never over pairs.
"""

from __future__ import annotations

import numpy as np

CELLS = 1 << 22  # characters of second strings (padded) that one step compares


def _points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in order, and where each string starts (one more entry for the end)."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(s) for s in strings], dtype=np.int64)))


def _padded(flat: np.ndarray, start: np.ndarray, pick: np.ndarray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(pick), width), fill, dtype=np.int32)
    size = start[pick + 1] - start[pick]
    row = np.repeat(np.arange(len(pick)), size)
    col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, col] = flat[np.repeat(start[pick], size) + col]
    return out


def _group(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths for padded code points a (n x la) and b (n x 64 * lanes)."""
    n, lanes = len(a), b.shape[1] // 64
    state = np.full((lanes, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(a.shape[1]):
        match = np.packbits(b == a[:, j, None], axis=1, bitorder="little").view("<u8").T  # lanes x n
        carry = np.zeros(n, dtype=np.uint64)
        for w in range(lanes):
            v = state[w]
            u = v & match[w]
            part = v + u
            total = part + carry
            carry = ((part < v) | (total < part)).astype(np.uint64)
            state[w] = total | (v & ~u)
    return 64 * lanes - np.bitwise_count(state).sum(axis=0, dtype=np.int64)


def lcs_lengths(first: list[str], second: list[str]) -> np.ndarray:
    """LCS length of each pair; any lengths, any characters."""
    short = [a if len(a) <= len(b) else b for a, b in zip(first, second)]
    long = [b if len(a) <= len(b) else a for a, b in zip(first, second)]
    out = np.zeros(len(short), dtype=np.int64)
    (fs, at_s), (fl, at_l) = _points(short), _points(long)
    n_short, n_long = np.diff(at_s), np.diff(at_l)
    lanes = -(-n_short // 64)
    order = np.lexsort((n_long, lanes))
    order = order[n_short[order] > 0]
    i = 0
    while i < len(order):
        width = int(lanes[order[i]])
        most = max(1, CELLS // (64 * width))
        j = i
        while j < len(order) and j - i < most and lanes[order[j]] == width:
            j = min(len(order), i + most, j + 4096)
        j = i + int(np.searchsorted(lanes[order[i:j]], width, side="right"))  # one lane count a group
        pick = order[i:j]
        a = _padded(fl, at_l, pick, int(n_long[pick].max()), -1)
        b = _padded(fs, at_s, pick, 64 * width, -2)
        out[pick] = _group(a, b)
        i = j
    return out


def indel_ratios(first: list[str], second: list[str]) -> np.ndarray:
    """100 * 2 * LCS / (len a + len b) of each pair; two empty strings -> 100."""
    total = np.array([len(a) + len(b) for a, b in zip(first, second)], dtype=np.float64)
    lcs = lcs_lengths(first, second)
    return np.where(total > 0, 200.0 * lcs / np.maximum(total, 1.0), 100.0)
