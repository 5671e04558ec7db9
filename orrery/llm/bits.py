"""Bitmaps of hashed keys that go into a scan to keep most rows that can't match from leaving their task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bitmap has PER_KEY cells a key or up to twice that, and at most so many (16 MB). A fuller one only lets more rows pass; it loses none.
MAX_CELLS = 1 << 27
PER_KEY = 32
#: Cells in one row of Spark's bitmap functions.
_ROW = 32768


def bitmap(keys: DataFrame, key: Column, max_cells: int = MAX_CELLS) -> np.ndarray:
    """A bit for each of the two cells that a key falls into, the cells being the low bits of both halves of the 64-bit hash
    `key`. Tasks put their bits together first, so the driver gets at most max_cells bits."""
    cells = min(max_cells, max(_ROW, 1 << (PER_KEY * max(keys.count(), 1) - 1).bit_length()))
    both = F.array(key, F.shiftrightunsigned(key, 32))
    rows = keys.select(F.explode(F.transform(both, lambda h: h.bitwiseAND(F.lit(cells - 1)) + 1)).alias("cell"))
    at, bit = F.call_function("bitmap_bucket_number", F.col("cell")), F.call_function("bitmap_bit_position", F.col("cell"))
    out = np.zeros(cells // 8, dtype=np.uint8)
    for r in rows.groupBy(at.alias("at")).agg(F.call_function("bitmap_construct_agg", bit).alias("bits")).collect():
        out[(r["at"] - 1) * (_ROW // 8) : r["at"] * (_ROW // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (int64) may be among the keys."""
    mask = len(bits) * 8 - 1
    set_ = lambda cell: (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 != 0
    out = set_(hashes & mask)
    some = np.flatnonzero(out)
    out[some] = set_((hashes[some] >> 32) & mask)
    return out
