"""SuperMinHash signatures for batches of sets, in numpy.

Every element walks the bins in its own pseudo-random order; at step ``j`` it offers the
value ``j + u`` (``u`` uniform) to the bin at rank ``j``, so an element's offers are
correlated through one permutation. The classic early stop applies per set: once every bin
of a set holds a value below ``j + 1``, later steps cannot change it. All sets of a batch
take a step together and finished sets leave.
"""

from __future__ import annotations

import numpy as np

from cadence.llm.wordhash import mix

_U = np.uint64
MAX_BINS = 256
_STRIDE = 0x632BE59BD9B4E019


def signatures(elements: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """(sets x bins) uint32 signatures; value = step << 24 | fraction. Empty sets: all ones.

    ``elements``: 64-bit hashes of distinct elements, set after set; ``counts``: set sizes.
    """
    if not 2 <= bins <= MAX_BINS:
        raise ValueError("bins must be from 2 to 256")
    sig = np.full(len(counts) * bins, 0xFFFFFFFF, dtype=np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = elements
    # step 0 needs no permutation state: the first rank is a uniform bin
    x = mix(h + _U(_STRIDE))
    k = ((x >> _U(32)) * _U(bins)) >> _U(32)
    np.minimum.at(sig, owner * bins + k.astype(np.int64), (x & _U(0xFFFFFF)).astype(np.uint32))
    live = (sig.reshape(-1, bins) == 0xFFFFFFFF).any(axis=1)[owner]
    owner, h, k = owner[live], h[live], k[live].astype(np.int64)
    perm = np.tile(np.arange(bins, dtype=np.uint8), (len(h), 1))
    row = np.arange(len(h))
    perm[row, k] = 0  # swap of ranks 0 and k; rank 0 is used up
    step = 1
    while len(h) and step < bins:
        x = mix(h + _U(_STRIDE * (step + 1) & 0xFFFFFFFFFFFFFFFF))
        k = step + (((x >> _U(32)) * _U(bins - step)) >> _U(32)).astype(np.int64)
        bin_ = perm[row, k]
        perm[row, k] = perm[row, step]
        np.minimum.at(sig, owner * bins + bin_, (_U(step << 24) | (x & _U(0xFFFFFF))).astype(np.uint32))
        step += 1
        live = (sig.reshape(-1, bins) == 0xFFFFFFFF).any(axis=1)[owner]
        if not live.all():
            owner, h, perm = owner[live], h[live], perm[live]
            row = np.arange(len(h))
    return sig.reshape(-1, bins)
