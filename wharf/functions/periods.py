"""Period arithmetic and labels (X-01, X-03..X-13) as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wharf.functions.casts import _c

# Month abbreviations used in the "End Of Mon YYYY" freshness label.
MONTH_ABBREVIATIONS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
                       "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def two_digit_year(year: Column) -> Column:
    """SUBSTR(CAST(year AS STRING), 3): the last two digits of a 4-digit year."""
    return F.substring(year.cast("string"), 3, 2)


def quarter_label(d, prefix: str = "FY", start_month: int = 9) -> Column:
    """'FYyyQq' for a fiscal year starting in ``start_month`` (1 = calendar year).

    The fiscal year is named after the calendar year in which it ends.
    """
    d = _c(d)
    m = F.month(d)
    shifted = F.pmod(m - F.lit(start_month), F.lit(12))
    year = F.year(d) + (m >= start_month).cast("int") if start_month > 1 else F.year(d)
    q = (F.floor(shifted / 3) + 1).cast("int")
    return F.concat(F.lit(prefix), two_digit_year(year), F.lit("Q"), q.cast("string"))


def prior_year_label(label, prefix: str | None = None) -> Column:
    """'FY24Q1' -> 'FY23Q1' by int arithmetic, as the reference does it.

    ``prefix`` is the literal put in front ('FY' or 'CY'); by default the
    label's own first two characters. The year goes through an integer, so a
    leading zero is lost ('FY10Q1' -> 'FY9Q1'); that is the reference's behaviour.
    """
    label = _c(label)
    prefix = F.substring(label, 1, 2) if prefix is None else F.lit(prefix)
    year = F.substring(label, 3, 2).try_cast("int") - 1
    return F.concat(prefix, year.cast("string"), F.right(label, F.lit(2)))


def quarter_slot(month: Column) -> Column:
    """X-01 anchor slot of a month: {9,12,3,6}->1, {10,1,4,7}->2, {11,2,5,8}->3."""
    return (F.pmod(month, F.lit(3)) + 1).cast("int")


def fiscal_slot_label(d, anchor_slot: Column) -> Column:
    """X-01 'FYyyQq-Mm' when the month of ``d`` sits in the anchor's slot, else NULL.

    Fiscal quarters run Aug-Oct, Nov-Jan, Feb-Apr, May-Jul; the fiscal year is
    named after the calendar year in which it ends.
    """
    d = _c(d)
    m = F.month(d)
    offset = F.pmod(m - F.lit(8), F.lit(12))
    fy = F.year(d) + (m >= 8).cast("int")
    label = F.concat(F.lit("FY"), two_digit_year(fy),
                     F.lit("Q"), (F.floor(offset / 3) + 1).cast("int").cast("string"),
                     F.lit("-M"), (F.pmod(offset, F.lit(3)) + 1).cast("string"))
    return F.when(quarter_slot(m) == anchor_slot, label)


def data_as_of_label(datekey_text) -> Column:
    """X-11 'yyyyMMdd...' text -> 'End Of Mon yyyy'; NULL when the month is not 01..12."""
    k = _c(datekey_text)
    months = F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS])
    mm = F.substring(k, 5, 2)
    valid = mm.isin(*[f"{i:02d}" for i in range(1, 13)])
    name = F.try_element_at(months, mm.try_cast("int"))
    return F.when(valid, F.concat(F.lit("End Of "), name, F.lit(" "), F.substring(k, 1, 4)))


def fyq_as_of_label(fyq) -> Column:
    """X-11 'FYyyQq' -> 'Qq Of 20yy'."""
    fyq = _c(fyq)
    return F.concat(F.substring(fyq, 5, 2), F.lit(" Of "),
                    F.concat(F.lit("20"), F.substring(fyq, 3, 2)))
