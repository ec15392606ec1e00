"""A filter of 64-bit hashes: a bit array whose size doesn't depend on how many hashes it holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a place in the filter.
FILTER_BITS = 25


def hash_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """The filter (2^bits bits, as bytes) of a column of hashes (longs); each sets two places."""
    low = lambda shift: F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1))
    spots = hashes.select(F.explode(F.array(low(64 - bits), low(64 - 2 * bits))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 31 AS INT))")).alias("bits")).toArrow()
    filled = np.zeros(1 << (bits - 5), "<u4")
    filled[words["word"].to_numpy()] = words["bits"].to_numpy().astype("<u4")
    return filled.view(np.uint8)


def may_hold(filled: np.ndarray, hashes: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Places of hashes (uint64) that the filter may hold: all that it does, and few others while it is far from full."""
    at = np.arange(len(hashes))
    for shift in (64 - bits, 64 - 2 * bits):
        place = (hashes[at] >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
        at = at[(filled[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
    return at
