"""A Bloom filter of 64-bit hashes that goes to every task; its size follows the number of hashes up to a fixed bound.

It only saves shuffling: what passes is joined by hash, so a filter that is full changes no result. Two bits per hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 bits per hash, at least 2^20 bits, at most 2^29 (64 MB, the bound of what is sent to the driver and to tasks).
BITS_PER_HASH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29


def bits_for(n: int) -> int:
    """The number of bits for n hashes: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, BITS_PER_HASH * n) - 1).bit_length()))


def build(hashes: DataFrame, column: str = "h", bits: int | None = None) -> np.ndarray:
    """The filter of a column of hashes."""
    bits = bits or bits_for(hashes.count())
    mask = bits - 1
    both = hashes.select(F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, 34).bitwiseAND(F.lit(mask)))).alias("b"))
    return combined(both.select(F.shiftright("b", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v")), bits)


def words(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a filter that some hashes set, and their bits."""
    mask = np.uint64(bits - 1)
    at = np.unique(np.concatenate((h & mask, (h >> np.uint64(34)) & mask)))
    w, first = np.unique(at >> np.uint64(6), return_index=True)
    return w.astype(np.int32), np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at


def combined(table: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes of (w, v). Words are combined on the executors; the driver gets at most one row per word of 64 bits."""
    rows = table.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    if len(rows):
        out[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def contains(filter_bytes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    mask = np.uint64(len(filter_bytes) * 8 - 1)
    out = np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(34)) & mask):
        out &= (filter_bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
