"""Current-versus-comparison period flags (X-03..X-09, A-01..A-03, J-01).

The reference joins each fact row to a one-row CTE (``FROM fact, maxQuarter``)
and tests the row against it in a CASE. Here the one-row values are scalar
subqueries (``DataFrame.scalar()``): Spark runs each aggregate once (partial
aggregation map-side), inlines the value into the outer plan, and can push it
into the scan as a runtime filter. No join, nothing broadcast, no row pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(source: DataFrame, agg: Column) -> Column:
    """A one-row aggregate of ``source`` as a Column (A-01/A-03 + J-01)."""
    return source.select(agg).scalar()


def first_match_flag(cases: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """CASE WHEN p1 THEN v1 WHEN p2 THEN v2 ... ELSE NULL END (first match wins)."""
    out = None
    for cond, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    if otherwise is not None:
        out = out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return out
