"""Vectorised word and shingle hashing over batches of UTF-8 texts.

Words are maximal runs of bytes other than space and 0x09-0x0D, ASCII letters lowered.
A word's 64-bit hash is a polynomial over random byte values modulo 2**64, taken from
prefix sums, then mixed; a shingle's hash mixes its words' hashes in order. All work is
numpy over one buffer; texts are never cut.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK_BYTES = 1 << 20
_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        n = max(n, CHUNK_BYTES * 2)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POW[:] = out
    return _POW[0], _POW[1]


def chunks(sizes, limit: int = CHUNK_BYTES):
    """Index ranges [a, b) of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    a = total = 0
    for i, s in enumerate(sizes):
        if i > a and total + s > limit:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def slices(batch, column: int, limit: int = CHUNK_BYTES, row_cost: int = 64):
    """Slices of an Arrow batch with about ``limit`` bytes in a text column; a row costs ``row_cost`` besides."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + row_cost
    for a, b in chunks(sizes.tolist(), limit):
        yield batch.slice(a, b - a)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a buffer."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, words per text, and byte starts/ends within the joined buffer.

    Texts are joined by one newline, so no word crosses two texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    start, end = word_spans(data)
    pw, inv = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * pw[: len(data)], dtype=np.uint64, out=prefix[1:])
    h = mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, bounds)
    return h, np.diff(np.concatenate(([0], upto))), start, end


def shingles(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of ``width`` words in order, and shingles per text.

    A text with fewer words (but some) has its whole sequence as its only shingle.
    """
    n = len(h)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    if n == 0:
        return h[:0], per
    ends = np.cumsum(counts)
    begin = ends - counts
    first = np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(per.sum())
    have = np.repeat(np.minimum(counts, width), per)
    out = have.astype(np.uint64)
    for j in range(width):
        at = np.minimum(first + j, n - 1)
        out = np.where(j < have, mix(out * _U(0x9E3779B97F4A7C15) + h[at]), out)
    return out, per
