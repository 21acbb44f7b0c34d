"""Ids of text pieces, computed once for each distinct piece that a worker meets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import PrefixHash

Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class PieceMemo:
    """Maps pieces, known by their 64-bit hash, to id sequences held in one pool.

    ``encode(data, starts, ends)`` gives the ids of some pieces, one after the other, and how many each has. The hashes
    stand in an open table that is searched and filled for many pieces at a time. At most half its slots are used;
    beyond that the memo starts afresh.
    """

    def __init__(self, encode: Encode, slots: int = 1 << 22):
        self.encode, self.slots = encode, slots
        self._forget()

    def _forget(self) -> None:
        self.keys, self.places = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.known = 0
        self.starts, self.sizes, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(self.slots - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it isn't known."""
        found, slot, open_ = np.full(len(keys), -1, np.int64), self._slot(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) % self.slots
        return found

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.places[slot[won]] = numbers[won]
            open_ = np.setdiff1d(open_, won, assume_unique=True)
            slot[open_] = (slot[open_] + 1) % self.slots

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, sizes = self.encode(data, starts, ends)
        self.pool = _room(self.pool, self.used + len(ids))
        self.starts, self.sizes = _room(self.starts, self.known + len(keys)), _room(self.sizes, self.known + len(keys))
        self.pool[self.used:self.used + len(ids)] = ids
        here = slice(self.known, self.known + len(keys))
        self.starts[here], self.sizes[here] = self.used + np.cumsum(sizes) - sizes, sizes
        self._insert(keys, np.arange(self.known, self.known + len(keys), dtype=np.int32))
        self.used, self.known = self.used + len(ids), self.known + len(keys)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after the other, and how many each has."""
        keys = PrefixHash(data).of(starts, ends) | np.uint64(1)  # 0 marks a free slot
        found = self._find(keys)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            distinct, first = np.unique(keys[fresh], return_index=True)
            if self.known + len(distinct) > self.slots // 2:
                self._forget()
                fresh = np.arange(len(keys))  # the pieces of one call have to be known together
                distinct, first = np.unique(keys, return_index=True)
                while len(distinct) > self.slots // 2:
                    self.slots *= 2
                    self._forget()
            self._learn(data, distinct, starts[fresh[first]], ends[fresh[first]])
            found[fresh] = self._find(keys[fresh])
        sizes = self.sizes[found].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(self.starts[found] - before, sizes) + np.arange(int(sizes.sum()))]
        return ids, sizes


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a larger one that begins with it, with ``size`` places at least."""
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[:len(array)] = array
    return larger
