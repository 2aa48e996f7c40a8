"""Minimal perfect hashing of 64-bit keys by cascaded bit sets, with fingerprints.

Level after level, keys that alone fall on a bit set it; the others go on.  A key's slot is
the rank of its bit among all set bits, so n distinct keys fill slots 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from corpuscle.llm.support import mixed

GAMMA = 2  # bits of a level for each key that reaches it
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys + np.uint64(level + 1) * _STEP)


class PerfectHash:
    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct unsigned 64-bit keys; levels are added until no key is left."""
        rest, sizes, parts = keys.astype(np.uint64), [], []
        while len(rest):
            m = -(-max(GAMMA * len(rest), 64) // 64) * 64
            at = (hashed(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("keys repeat")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1; a key that isn't in the set may get any slot."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(todo):
                break
            bit = self.starts[level] + (hashed(keys[todo].astype(np.uint64), level) % np.uint64(m)).astype(np.int64)
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.words[word] >> shift) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[todo[here]] = (self.before[word] + np.bitwise_count(below))[here]
            todo = todo[~here]
        return out
