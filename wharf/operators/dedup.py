"""De-duplication: latest row per key (W-01..W-04) and duplicate audit (W-05, U-04).

``latest_per_key`` is ``row_number() == 1`` over a key window. Catalyst turns
that into a WindowGroupLimit that runs a *partial* top-1 in every map task
before the shuffle, so a key holding a third of all rows is first cut to one
row per input partition and never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RN = "__wharf_rn"


def _as_sort(c, default_desc: bool = True) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c).desc_nulls_last() if default_desc else F.col(c).asc_nulls_first()


def rank_column(keys: Sequence, order: Sequence, tiebreak: Sequence = ()) -> Column:
    """ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order, tiebreak).

    Plain column names in ``order``/``tiebreak`` sort descending (newest first,
    NULLs last, as BigQuery's DESC does); pass Columns for other directions.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    w = Window.partitionBy(*keys).orderBy(*[_as_sort(c) for c in (*order, *tiebreak)])
    return F.row_number().over(w)


def latest_per_key(df: DataFrame, keys: Sequence, order: Sequence,
                   tiebreak: Sequence = ()) -> DataFrame:
    """W-01/W-02/W-03/W-04: keep the first row per key under ``order``.

    ``keys`` may hold expressions (W-02 partitions on normalised date-times).
    The reference gives no tie-break; pass ``tiebreak`` columns to make the
    choice deterministic.
    """
    return (df.withColumn(_RN, rank_column(keys, order, tiebreak))
              .where(F.col(_RN) == 1)
              .drop(_RN))


def duplicates(df: DataFrame, keys: Sequence[str], count_col: str = "n_rows") -> DataFrame:
    """W-05/U-04: keys that occur more than once, with their row count.

    A grouped count aggregates map-side first, so a hot key costs one partial
    row per task.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
              .where(F.col(count_col) > 1))
