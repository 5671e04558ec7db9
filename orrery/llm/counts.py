"""Exact counts of keys, pruned by their share of all, and looked up by whole arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_built: dict[str, tuple] = {}


class Table:
    """Counts of distinct int64 keys under open addressing; keys that aren't there count 0. Only the keys and counts travel
    to tasks; a worker lays the table out once."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.name, self.keys, self.counts = uuid.uuid4().hex, np.asarray(keys, dtype=np.int64), np.asarray(counts, dtype=np.float32)
        self._lay()

    def __getstate__(self):
        return self.name, self.keys, self.counts

    def __setstate__(self, state):
        self.name, self.keys, self.counts = state
        self._lay()

    def _lay(self):
        if self.name not in _built:
            _built.clear()  # a worker serves one query at a time
            bits = max(4, (4 * len(self.keys) - 1).bit_length()) if len(self.keys) else 4
            slot, value = np.zeros(1 << bits, dtype=np.int64), np.full(1 << bits, -1, dtype=np.float32)
            rest, at = np.arange(len(self.keys)), self._at(self.keys, bits)
            while len(rest):
                free = np.flatnonzero(value[at] < 0)
                _, first = np.unique(at[free], return_index=True)
                put = free[first]
                slot[at[put]], value[at[put]] = self.keys[rest[put]], self.counts[rest[put]]
                keep = np.ones(len(rest), dtype=bool)
                keep[put] = False
                rest, at = rest[keep], (at[keep] + 1) & ((1 << bits) - 1)
            _built[self.name] = bits, slot, value
        self.bits, self.slot, self.value = _built[self.name]

    @staticmethod
    def _at(keys: np.ndarray, bits: int) -> np.ndarray:
        h = keys.view(np.uint64) * _FACTOR
        h ^= h >> np.uint64(32)
        return ((h * _FACTOR) >> np.uint64(64 - bits)).astype(np.int64)

    def one(self, key: int) -> float:
        """The count of one key, given as an unsigned number."""
        h = key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h = (h ^ h >> 32) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        at, signed = h >> (64 - self.bits), key - (key >> 63 << 64)
        while (v := self.value[at]) >= 0:
            if self.slot[at] == signed:
                return float(v)
            at = (at + 1) & (len(self.slot) - 1)
        return 0.0

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys, self.bits)
        out = self.value[at]
        # Most keys are settled at once; the others go on until their own slot or an empty one.
        rest = np.flatnonzero((out >= 0) & (self.slot[at] != keys))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.slot) - 1)
            v = self.value[at]
            out[rest] = v
            on = (v >= 0) & (self.slot[at] != keys[rest])
            rest, at = rest[on], at[on]
        return np.maximum(out, 0)


def tallied(arrays, limit: int = 4_000_000):
    """(key, n) frames of the arrays of int64 keys that come in; equal keys are put together over `limit` keys at a time."""
    waiting, size = [], 0

    def out():
        k, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pd.DataFrame({"key": k, "n": n.astype(np.int64)})

    for a in arrays:
        waiting.append(a)
        size += len(a)
        if size >= limit:
            yield out()
            waiting, size = [], 0
    if size:
        yield out()


def pruned(counts: DataFrame, total: float, share: float, least: int = 1) -> pd.DataFrame:
    """The (key, n) rows that hold at least `share` of the total, and at least `least`: 1 / share rows at most, so their
    number has a bound that doesn't depend on the corpus."""
    return counts.where(F.col("n") >= max(least, total * share)).toPandas()
