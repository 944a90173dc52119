"""Static binary-fuse filters over 64-bit keys, built and asked in whole arrays.

A filter of ``n`` keys is an array of bytes in segments of a power of two.
Each key has a slot in each of three neighbouring segments, and the
exclusive-or of the three bytes is the key's fingerprint.  Slots are given out
by peeling: whatever is the only key of some slot is put aside, round by
round, and the bytes are set in the opposite order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from echolens.llm.bytetext import mix

U = np.uint64
#: Seeds that are tried; one in a few hundred filters needs a second.
MOST_SEEDS = 100


@dataclass(frozen=True)
class Fuse:
    """A filter: no key that it was built from is ever answered no, others with a chance of 1 in 256."""

    seed: int
    bits: int
    segments: int
    slots: np.ndarray

    @staticmethod
    def build(keys: np.ndarray) -> Fuse:
        """A filter of the distinct ones among ``keys`` (64-bit integers of either sign)."""
        keys = np.unique(keys.astype(np.int64)).view(np.uint64)
        n = len(keys)
        bits = max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * factor / (1 << bits)))
        for seed in range(MOST_SEEDS):
            slots = _assigned(keys, seed, bits, segments)
            if slots is not None:
                return Fuse(seed, bits, segments, slots)
        raise RuntimeError(f"no binary-fuse filter for {n} keys within {MOST_SEEDS} seeds")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be one of the filter's."""
        at, print_ = _places(keys.astype(np.int64).view(np.uint64), self.seed, self.bits, self.segments)
        return (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]) == print_


def _places(keys: np.ndarray, seed: int, bits: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, and its fingerprint."""
    h = mix(keys ^ U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    size, mask = U(1 << bits), U((1 << bits) - 1)
    first = (h >> U(32)) * U(segments << bits) >> U(32)
    at = np.stack([first, (first + size) ^ (h >> U(18) & mask), (first + size + size) ^ (h & mask)])
    return at.astype(np.int64), ((h ^ (h >> U(32))) & U(255)).astype(np.uint8)


def _assigned(keys: np.ndarray, seed: int, bits: int, segments: int) -> np.ndarray | None:
    """The filter's bytes, or None if the keys cannot all be peeled with this seed."""
    at, print_ = _places(keys, seed, bits, segments)
    size = (segments + 2) << bits
    held = np.bincount(at.ravel(), minlength=size)
    which = np.zeros(size, dtype=np.int64)  # exclusive-or of the keys in a slot: the key itself where there is one
    for row in at:
        np.bitwise_xor.at(which, row, np.arange(len(keys)))
    rounds, peeled, alone = [], 0, np.flatnonzero(held == 1)
    while len(alone):
        key, first = np.unique(which[alone], return_index=True)
        rounds.append((key, alone[first]))
        peeled += len(key)
        gone = at[:, key]
        np.subtract.at(held, gone.ravel(), 1)
        np.bitwise_xor.at(which, gone.ravel(), np.tile(key, 3))
        alone = np.unique(gone.ravel())
        alone = alone[held[alone] == 1]
    if peeled < len(keys):
        return None
    slots = np.zeros(size, dtype=np.uint8)
    for key, slot in reversed(rounds):
        a = at[:, key]
        slots[slot] = 0
        slots[slot] = print_[key] ^ slots[a[0]] ^ slots[a[1]] ^ slots[a[2]]
    return slots
