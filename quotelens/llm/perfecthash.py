"""A minimal perfect hash of distinct 64-bit keys: levels of bit arrays, a key's number is the rank of its bit.

At each level the keys that are left are scattered over twice as many bits; a key alone at its bit
stays there, the others go on to the next level. About 3.7 bits a key.
"""

from __future__ import annotations

import numpy as np

from .common import mix

BITS_PER_KEY = 2
_STEP = 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ mix(np.array([(level + 1) * _STEP % 2**64], np.uint64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``sizes`` and ``bits`` (packed) of the levels; ``index`` numbers the keys it was built from 0 to n-1."""

    def __init__(self, sizes: list[int], bits: list[bytes]):
        self.sizes, self.bits = sizes, bits
        self._levels, below = [], 0
        for size, packed in zip(sizes, bits):
            flags = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
            self._levels.append((flags, below + np.cumsum(flags) - 1))
            below += int(flags.sum())
        self.n = below

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left = np.asarray(keys).astype(np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("a perfect hash needs distinct keys")
        sizes, bits = [], []
        while len(left):
            size = max(64, BITS_PER_KEY * len(left))
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            left = left[~alone[at]]
        return cls(sizes, bits)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; a key that was not built in gets any number, or -1, so callers compare the stored key."""
        keys = np.asarray(keys).astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        pending = np.arange(len(keys))
        for level, (flags, ranks) in enumerate(self._levels):
            at = _places(keys[pending], level, len(flags))
            here = flags[at]
            out[pending[here]] = ranks[at[here]]
            pending = pending[~here]
        return out
