"""Array helpers that the numpy-backed operators share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa


def tidy(run, forget=None):
    """``run``, a function for mapInArrow, that gives its memory back when its task ends: workers live
    on for later tasks. ``forget`` is called before that."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return tidied


class IntMap:
    """A read-only map from int64 keys to int32 values with vectorised look-up (open addressing)."""

    def __init__(self, keys, values):
        keys = np.asarray(keys, np.int64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        values = np.asarray(values, np.int32)
        while len(todo):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[todo[won]], values[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys):
        """Values of ``keys`` (non-negative), -1 where absent."""
        keys = np.asarray(keys, np.int64)
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at_ = (at[todo] + 1) & self.mask
            at[todo] = at_
            seen = self.keys[at_]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at_[hit]]
            todo = todo[~hit & (seen >= 0)]
        return out


def ranges(starts, lengths):
    """Concatenated ``arange(start, start + length)``."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
