"""Work by key in slices, so that its shuffle files are those of one slice at a time.

A window or a merge by key moves all of its rows through the disks at once. Rows whose keys
fall in one slice never meet those of another, so the slices can be done and written one
after the other. Their number is bounded: the input is read once per slice, its key columns
for all rows and the others for the rows of the slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SLICES = 8
SLICE_ROWS = 400_000


def slice_count(rows: int) -> int:
    return max(1, min(MOST_SLICES, rows // SLICE_ROWS))


def take_slice(df: DataFrame, keys: Sequence[str | Column], i: int, n: int) -> DataFrame:
    """Slice ``i`` of ``n``: rows with equal ``keys`` (NULL is a key like any other) share one."""
    return df if n == 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)


def sliced(make: Callable[[int], DataFrame], n: int, others: DataFrame | None = None) -> list[DataFrame]:
    """The slices ``make(0)``.., the first with ``others``, rows that need no work."""
    parts = [make(i) for i in range(n)]
    return parts if others is None else [parts[0].unionByName(others), *parts[1:]]
