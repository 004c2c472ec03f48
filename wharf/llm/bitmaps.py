"""Bitmaps of fixed size: which keys may be in a set, whatever the set's size.

A key that is in the set always has its bit; another key has it by chance only.
The bitmap is built by Spark's bitmap aggregates; its size, not the data, bounds
what reaches the driver and the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.session import materialize


def bit_of(key: Column, bits: int) -> Column:
    """Bit number, from 0, of a long key."""
    return F.pmod(key, F.lit(bits))


def build(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bytes of the bitmap (``bits`` / 8 of them) of a column of bit numbers."""
    made = materialize(
        keys.select((F.col(column) + 1).alias("b"))
        .groupBy(F.bitmap_bucket_number("b").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")), "bitmap")
    out = np.zeros(bits // 8, np.uint8)
    for row in made.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        piece = np.frombuffer(row["bits"], np.uint8)[:len(out) - at]
        out[at:at + len(piece)] = piece
    return out


def test(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    n = numbers.astype(np.int64)
    return (bitmap[n >> 3] >> (n & 7).astype(np.uint8)) & 1 > 0
