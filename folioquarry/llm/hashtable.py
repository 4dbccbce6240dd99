"""A table of 64-bit keys and values in numpy, looked up and filled a whole array at a time; open addressing, bounded."""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOAD = 0.6


class HashTable:
    """2**bits places; add() clears the table first where it would become too full. The key 2**64 - 1 is not allowed."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int64)
        self.most, self.n = int(_LOAD * (1 << bits)), 0

    def clear(self) -> None:
        self.keys[:] = _EMPTY
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = (keys * _MIX) >> self.shift
        there = self.keys[at]
        hit = there == keys
        out = np.where(hit, self.values[at], -1)
        rest = np.flatnonzero(~hit & (there != _EMPTY))
        while len(rest):
            at[rest] = own = (at[rest] + np.uint64(1)) & self.mask
            there = self.keys[own]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[own[hit]]
            rest = rest[~hit & (there != _EMPTY)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that the table does not hold; as many as fit."""
        if self.n + len(keys) > self.most:
            self.clear()
        keys, values = keys[: self.most], values[: self.most]
        self.n += len(keys)
        at, rest = (keys * _MIX) >> self.shift, np.arange(len(keys))
        while len(rest):
            own = at[rest]
            free = rest[self.keys[own] == _EMPTY]
            self.keys[at[free]] = keys[free]  # of two that want one place the last has it
            won = self.keys[at[free]] == keys[free]
            self.values[at[free[won]]] = values[free[won]]
            rest = rest[self.keys[own] != keys[rest]]
            at[rest] = (at[rest] + np.uint64(1)) & self.mask
