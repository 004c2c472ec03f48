"""Anchor snapshot selection (X-02, P-13, P-14, J-09).

The reference keeps fact rows whose ``datekey`` is one of 24 computed anchor
dates, each a scalar subquery over the fact table (58 table references). Each
anchor is "the newest datekey (any period) of a given calendar month", with
the month derived from a handful of base facts.

Plan here, for a table of any size:
1. one grouped aggregate per distinct datekey (max QuarterClosed, whether an
   'ME' snapshot exists): partial aggregation map-side; the result has one row
   per snapshot date, i.e. it grows with the calendar, not with the data;
2. base facts and the per-month newest datekey from that small table;
3. anchors = months whose prefix is in the computed list, one scalar subquery (at most
   one row per prefix, so at most 24 rows: a proven bound), broadcast to a left-semi
   join with the facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.functions.casts import datekey_to_date, format_wall
from wharf.session import materialize as materialize_table


@dataclass(frozen=True)
class AnchorSpec:
    key: str = "Datekey"
    period_col: str = "PeriodCd"
    quarter_col: str = "QuarterClosed"
    month_end: str = "ME"
    # Fixed value: the reference's literal FY20 year-end datekey.
    fixed: tuple[int, ...] = (20200904,)
    quarters_back: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    years_back: tuple[int, ...] = (1, 2)


def _prefix_back(max_me: Column, months: int) -> Column:
    """SUBSTR(FORMAT_DATE('%Y%m%d', DATE_SUB(date(max_me), INTERVAL months MONTH)), 0, 6)."""
    return format_wall(F.add_months(datekey_to_date(max_me), -months), "yyyyMM")


def _fy_prefix(fy2: Column, delta: int, mm: str) -> Column:
    """CONCAT('20', CAST(fy AS INT64) + delta, 'mm'): int arithmetic keeps the quirks."""
    return F.concat(F.lit("20"), (fy2.try_cast("bigint") + delta).cast("string"), F.lit(mm))


def per_datekey(facts: DataFrame, spec: AnchorSpec = AnchorSpec(),
                extra: dict[str, Column] | None = None, materialize: bool = True) -> DataFrame:
    """Step 1: one row per distinct datekey (plus ``extra`` aggregates).

    The result grows with the number of snapshot dates, not with the data. It
    is read by several scalar subqueries and a join, so by default it is
    written once as a small table under the session's ``spark.checkpoint.dir``
    instead of re-aggregating the facts for every reader.
    """
    keys = facts.groupBy(spec.key).agg(
        F.max(spec.quarter_col).alias("max_quarter"),
        F.max((F.col(spec.period_col) == spec.month_end).cast("int")).alias("has_me"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return materialize_table(keys, "per_datekey") if materialize else keys


def anchor_dates(facts: DataFrame, spec: AnchorSpec = AnchorSpec(),
                 keys: DataFrame | None = None) -> DataFrame:
    """X-02 the anchor datekeys as a DataFrame[datekey] (at most 24 rows).

    ``keys``: a ``per_datekey`` summary already computed by the caller.
    """
    k = F.col(spec.key)
    keys = per_datekey(facts, spec) if keys is None else keys
    is_me = F.col("has_me") == 1
    # All base facts in one pass over the small per-datekey table; one row per
    # datekey, so max(struct(k, q)).q is "MAX(QuarterClosed) at the newest k".
    newest = F.struct(k, F.col("max_quarter").alias("q"))
    base = keys.agg(
        F.max(F.when(is_me, k)).alias("max_me"),
        F.max(newest)["q"].alias("q_any"), F.max(F.when(is_me, newest))["q"].alias("q_me"))
    max_me = F.col("max_me")
    # SUBSTR(MAX(QuarterClosed), -4, 2) at the newest datekey of any period / of 'ME'.
    fy_any = F.col("q_any").substr(-4, 2)
    fy_me = F.col("q_me").substr(-4, 2)
    year_me = max_me.cast("string").substr(1, 4).try_cast("bigint")

    prefixes = [_prefix_back(max_me, 3 * q) for q in spec.quarters_back]
    prefixes += [_prefix_back(max_me, 12 * y) for y in spec.years_back]
    prefixes += [_fy_prefix(fy_any, d, "09") for d in (-3, -2, -1)]
    prefixes.append(F.concat((year_me - 1).cast("string"), F.lit("08")))
    for d in (-1, 0, -2):
        prefixes += [_fy_prefix(fy_me, d, mm) for mm in ("12", "03", "06")]

    # One scalar subquery holds the finished list, at most one prefix per anchor; "LIKE
    # 'yyyyMM%'" on the stringified key is equality of its first six characters.
    asked = base.select(F.struct(F.array(*prefixes).alias("prefixes"),
                                 F.array(max_me, *[F.lit(f) for f in spec.fixed]).alias("single"))).scalar()
    months = (keys.select(k.cast("string").substr(1, 6).alias("prefix"), k)
                  .where(F.array_contains(asked["prefixes"], F.col("prefix")))
                  .groupBy("prefix").agg(F.max(k).alias(spec.key)))
    fixed = keys.select(k).where(F.array_contains(asked["single"], k))
    return months.select(spec.key).unionByName(fixed).distinct()


def select_anchors(facts: DataFrame, anchors: DataFrame, key: str = "Datekey") -> DataFrame:
    """Keep fact rows on an anchor date: broadcast left-semi join (anchors <= 24 rows)."""
    return facts.join(F.broadcast(anchors.select(key)), key, "left_semi")
