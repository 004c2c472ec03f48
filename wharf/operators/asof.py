"""Snapshot "as of window" table function (F-01).

active rows -> SnapshotRowDateTime in [start, end] -> latest per key by
FileEffectiveDate DESC, CreateDate DESC -> typed projection.

The date filter is on a typed column of the snapshot, so it reaches the
parquet scan as a pushed filter (and partition filter on ParentSystemId when
``parent_id`` is given). The QUALIFY is a row_number window, which Catalyst
pre-limits map-side (see ``dedup``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.operators.dedup import latest_per_key


def snapshot_asof(snapshot: DataFrame, keys: Sequence[str], projection: Sequence[Column],
                  start, end, parent_id: int | None = None,
                  order: Sequence = ("FileEffectiveDate", "CreateDate"),
                  tiebreak: Sequence = (),
                  date_col: str = "SnapshotRowDateTime") -> DataFrame:
    """F-01 generic table function over an append-only snapshot.

    ``start``/``end`` are literals or Columns compared with ``date_col``
    (closed window, P-10). ``projection`` is the typed select list.
    """
    df = snapshot
    if parent_id is not None:
        df = df.where(F.col("ParentSystemId") == F.lit(parent_id))
    lo = start if isinstance(start, Column) else F.lit(start)
    hi = end if isinstance(end, Column) else F.lit(end)
    df = df.where(~F.col("InactiveInd") & (F.col(date_col) >= lo) & (F.col(date_col) <= hi))
    return latest_per_key(df, keys, order, tiebreak).select(*projection)
