"""Hash tables of 64-bit keys in numpy arrays, built and read for many keys at once."""

from __future__ import annotations

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Distinct keys (below 2**64 - 1) to their places in the array they came in; open addressing, at most half full."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        stored, place = keys.astype(np.uint64) + np.uint64(1), np.arange(len(keys), dtype=np.int32)
        at = self.home(keys)
        while len(stored):
            free = self.slots[at] == 0
            self.slots[at[free]] = stored[free]
            won = self.slots[at] == stored
            self.places[at[won]] = place[won]
            stored, place, at = stored[~won], place[~won], (at[~won] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.home(keys)
        held = self.slots[at]
        out = np.where(held == keys + np.uint64(1), self.places[at], np.int32(-1))
        left = np.flatnonzero((out < 0) & (held != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.slots[at]
            hit = held == keys[left] + np.uint64(1)
            out[left[hit]] = self.places[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], at[on]
        return out


class Counts:
    """Counts of 64-bit keys, gathered piece by piece; handed on when they grow beyond a bound, so memory stays bounded."""

    def __init__(self, most: int = 4_000_000):
        self.most, self.keys, self.counts, self.held = most, [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        """True if what is held should be handed on."""
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.held += len(k)
        if self.held > self.most:
            k, n = self.take()
            self.keys, self.counts, self.held = [k], [n], len(k)
            return self.held > self.most // 2
        return False

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        self.keys, self.counts, self.held = [], [], 0
        return keys[first], np.add.reduceat(counts, first).astype(np.int64) if len(first) else counts
