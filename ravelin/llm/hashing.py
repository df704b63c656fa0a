"""A table from 64-bit keys to row numbers with vectorised look-ups; a worker's memory of words and pieces it has met."""

from __future__ import annotations

import numpy as np

from ravelin.llm import textops


class KeyTable:
    """Open addressing; keys are not 0. Entries are numbered from 0 in the order in which keys were added."""

    def __init__(self):
        self.n = 0
        self._sized((1 << 16) - 1)

    def _sized(self, mask: int) -> None:
        self.mask = mask
        self.slots, self.entry = np.zeros(mask + 1, np.uint64), np.zeros(mask + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        pos = (keys & np.uint64(self.mask)).astype(np.int64)
        there = self.slots.take(pos)
        out = self.entry.take(pos)
        left = np.flatnonzero(there != keys)
        out[left] = -1
        left = left[there[left] != 0]
        pos = (pos[left] + 1) & self.mask
        while len(left):
            there = self.slots[pos]
            hit = there == keys[left]
            out[left[hit]] = self.entry[pos[hit]]
            on = ~hit & (there != 0)
            left, pos = left[on], (pos[on] + 1) & self.mask
        return out

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        left, pos = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[pos] == 0
            self.slots[pos[free]] = keys[left[free]]
            won = self.slots[pos] == keys[left]
            self.entry[pos[won]] = entries[left[won]]
            left, pos = left[~won], (pos[~won] + 1) & self.mask

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Entries of distinct keys that aren't there yet."""
        new = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if 2 * self.n > self.mask:
            held, own = self.slots[self.slots != 0], self.entry[self.slots != 0]
            mask = self.mask
            while 2 * self.n > mask:
                mask = 2 * mask + 1
            self._sized(mask)
            self._place(held, own)
        self._place(keys, new)
        return new


class Letters:
    """The letters of a table's entries, so that a hit can be compared."""

    def __init__(self):
        self.raw, self.used = textops.padded(np.zeros(1 << 16, np.uint8)), 0
        self.place, self.size, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def add(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Spans of ``padded`` bytes, as the next entries."""
        total, n = int(lengths.sum()), len(starts)
        while self.used + total > len(self.raw) - 8:
            self.raw = np.concatenate((self.raw, np.zeros_like(self.raw)))
        while self.n + n > len(self.place):
            self.place, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.place, self.size))
        at = np.cumsum(lengths) - lengths
        self.raw[self.used : self.used + total] = raw[np.repeat(starts - at, lengths) + np.arange(total)]
        self.place[self.n : self.n + n], self.size[self.n : self.n + n] = self.used + at, lengths
        self.used, self.n = self.used + total, self.n + n

    def differ(self, entry: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Indices of the spans that aren't the letters of their entry."""
        wrong = self.size.take(entry) != lengths
        there, here, places = textops.blocks(self.raw), textops.blocks(raw), self.place.take(entry)
        for left, at, rest in textops.block_steps(starts, lengths):
            wrong[left] |= textops.masked(here[at], rest) != textops.masked(there[np.minimum(places[left] + (at - starts[left]), len(there) - 1)], rest)
        return np.flatnonzero(wrong)
