"""Typed parsing of all-string staging data (T-01..T-15, P-04..P-07).

Every function maps Column -> Column and is built from Spark SQL expressions,
so it stays inside whole-stage codegen. "strict" forms raise on malformed input
under ANSI mode (the reference's CAST); "safe" forms return NULL (SAFE_CAST).

Time handling never depends on the session time zone: wall-clock values are
produced as TIMESTAMP_NTZ, and instants are turned into UTC wall time through
their epoch microseconds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's NUMERIC type is DECIMAL(38, 9).
NUMERIC = "decimal(38,9)"



def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _checked(s: Column, form: str) -> Column:
    """``s`` where it has the form; other text gets a mark that no cast accepts, so a strict cast raises."""
    return F.when(s.isNull() | s.rlike(form), s).otherwise(F.concat(s, F.lit(" (not of the form)")))


# --------------------------------------------------------------------------- numbers

_FLOAT_FORM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_numeric(s) -> Column:
    """T-01 strict NUMERIC cast (raises on malformed text under ANSI)."""
    return _c(s).cast(NUMERIC)


def safe_numeric(s) -> Column:
    """T-02 SAFE_CAST(s AS NUMERIC): malformed, '' and '95%' give NULL."""
    return _c(s).try_cast(NUMERIC)


def int_from_numeric(s, safe: bool = False) -> Column:
    """T-03 CAST(CAST(s AS NUMERIC) AS INT64): rounds half away from zero.

    Spark's decimal->bigint cast truncates, so round to 0 places first.
    """
    d = safe_numeric(s) if safe else to_numeric(s)
    rounded = F.round(d, 0)
    return rounded.try_cast("bigint") if safe else rounded.cast("bigint")


def safe_int(s) -> Column:
    """T-05 SAFE_CAST(SAFE_CAST(s AS NUMERIC) AS INT64)."""
    return int_from_numeric(s, safe=True)


def int_from_float_round(s) -> Column:
    """T-04 CAST(ROUND(CAST(s AS FLOAT64)) AS INT64); +-2.5 -> +-3.

    Decimal digits with an optional point and exponent; other text that Java reads as
    a number ('1.5d', '0x1p3') raises like any malformed text.
    """
    return F.round(_checked(_c(s), _FLOAT_FORM).cast("double")).cast("bigint")


def percent_numeric(s, safe: bool = True) -> Column:
    """T-06 strip '%' then NUMERIC."""
    stripped = F.replace(_c(s), F.lit("%"), F.lit(""))
    return safe_numeric(stripped) if safe else to_numeric(stripped)


# --------------------------------------------------------------------------- date-times

# A trailing zone designator after a time of day.
_HAS_ZONE = r"(?i)\d{1,2}:\d{2}(:\d{2}(\.\d*)?)?\s*(z|utc|gmt|[+-]\d{1,2}(:?\d{2})?)$"
_WALL_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
_DATED = r"^\d{4}-\d{1,2}-\d{1,2}($|[T\s])"
_DATE_ONLY = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"


def wall_datetime(s, safe: bool = True) -> Column:
    """T-07 wall-clock DATETIME from the first 19 characters; the offset is ignored.

    Only 'yyyy-MM-ddTHH:mm:ss' is accepted; other text, a year or a month alone
    included, is NULL in the safe form and raises in the strict one (under ANSI).
    """
    head = F.substring(_c(s), 1, 19)
    if not safe:
        return _checked(head, _WALL_FORM).cast("timestamp_ntz")
    return F.when(head.rlike(_WALL_FORM), head.try_cast("timestamp_ntz"))


def _with_zone(s: Column) -> Column:
    """Strings without a zone designator denote UTC: append one."""
    return (F.when(s.rlike(_HAS_ZONE), s)
            .when(s.rlike(_DATE_ONLY), F.concat(F.trim(s), F.lit("T00:00:00Z")))
            .otherwise(F.concat(s, F.lit("Z"))))


def instant_to_utc_ntz(ts: Column) -> Column:
    """An instant (TIMESTAMP) as its UTC wall time (TIMESTAMP_NTZ), zone-free."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)


def utc_datetime(s, safe: bool = True) -> Column:
    """T-08/T-09 CAST(TIMESTAMP(s) AS DATETIME): offset applied, result in UTC.

    The text must begin with a whole date: Spark's cast alone would also take a
    time of day (as of today), a year or a month. In the strict form other text
    reaches the cast unchanged but for a mark that no cast accepts, and raises.
    """
    whole = F.trim(_c(s)).rlike(_DATED)
    if safe:
        inst = F.when(whole, _with_zone(_c(s))).try_cast("timestamp")
    else:
        inst = F.when(whole | _c(s).isNull(), _with_zone(_c(s))).otherwise(F.concat(F.lit("no date: "), _c(s))).cast("timestamp")
    return instant_to_utc_ntz(inst)


safe_datetime = utc_datetime  # T-09: the same expression, used as a parse test


def _parse_wall(text: Column, fmt: str) -> Column:
    """Parse zone-less text with a pattern into TIMESTAMP_NTZ, NULL when bad."""
    inst = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{fmt} Z"))
    return instant_to_utc_ntz(inst)


# English month names used by the text date formats.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December")
_TOKEN = re.compile(r"yyyy|MMMM|MMM|MM|M|dd|d|HH|H|hh|h|mm|ss|a|'[^']*'|.")


def format_wall(ts, pattern: str) -> Column:
    """Render a wall-clock value (TIMESTAMP_NTZ or DATE) without any time zone.

    ``date_format`` converts TIMESTAMP_NTZ through the session zone, which
    moves wall times that fall in a daylight-saving gap; this builds the text
    from the value's own fields instead. Pattern letters: yyyy MMMM MMM MM M
    dd d HH H hh h mm ss a, literals in quotes.
    """
    ts = _c(ts)
    if pattern in ("yyyyMMdd", "yyyyMM"):  # numeric keys: plain arithmetic, no text fields
        ym = F.year(ts) * 100 + F.month(ts)
        key = ym * 100 + F.dayofmonth(ts) if pattern == "yyyyMMdd" else ym
        return F.lpad(key.cast("string"), len(pattern), "0")
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    hour = F.hour(ts)
    h12 = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = {
        "yyyy": F.lpad(F.year(ts).cast("string"), 4, "0"),
        "MMMM": F.element_at(months, F.month(ts)),
        "MMM": F.substring(F.element_at(months, F.month(ts)), 1, 3),
        "MM": pad(F.month(ts)), "M": F.month(ts).cast("string"),
        "dd": pad(F.dayofmonth(ts)), "d": F.dayofmonth(ts).cast("string"),
        "HH": pad(hour), "H": hour.cast("string"), "hh": pad(h12), "h": h12.cast("string"),
        "mm": pad(F.minute(ts)), "ss": pad(F.second(ts)),
        "a": F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM")),
    }
    out = []
    for tok in _TOKEN.findall(pattern):
        out.append(parts[tok] if tok in parts else F.lit(tok.strip("'") if len(tok) > 1 else tok))
    return F.when(ts.isNotNull(), F.concat(*out))


def reformat_us_timestamp(s) -> Column:
    """T-10 'Nov 1, 2024 8:05:09 PM' -> '11/01/2024 08:05:09 PM' (NULL if bad)."""
    ts = _parse_wall(F.trim(_c(s)), "MMM d, yyyy h:mm:ss a")
    return format_wall(ts, "MM/dd/yyyy hh:mm:ss a")


def parse_day_month_name(s) -> Column:
    """T-11 '%d-%B-%Y %H:%M%p': a 24-hour hour with an AM/PM suffix that is ignored."""
    core = F.regexp_replace(F.trim(_c(s)), r"(?i)\s*(AM|PM)$", "")
    return _parse_wall(core, "d-MMMM-yyyy H:mm")


def parse_mdy(s, safe: bool = True) -> Column:
    """T-12 PARSE_DATE('%m/%d/%Y'); one- or two-digit month and day."""
    return F.try_to_date(_c(s), "M/d/yyyy") if safe else F.to_date(_c(s), "M/d/yyyy")


def month_name_first_day(s) -> Column:
    """T-13 'January 2024' -> DATE 2024-01-01."""
    return F.try_to_date(_c(s), "MMMM yyyy")


def datekey_to_date(k) -> Column:
    """T-14 INT64 yyyyMMdd -> DATE."""
    return F.try_to_date(_c(k).cast("string"), "yyyyMMdd")


def typed_null(data_type: str) -> Column:
    """P-15 a NULL of a given type."""
    return F.lit(None).cast(data_type)


# --------------------------------------------------------------------------- normalisers

def blank_default(c, default: str = "blank") -> Column:
    """P-04 CASE WHEN c = '' OR c IS NULL THEN 'blank' ELSE c END."""
    c = _c(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(default)).otherwise(c)


def normalize_blank_to_empty(c) -> Column:
    """P-05 COALESCE(NULLIF(TRIM(c), ''), ''), with all white space trimmed."""
    return F.coalesce(F.nullif(trim_space(c), F.lit("")), F.lit(""))


# Fixed value: the characters that TRIM removes (Unicode white space).
WHITE_SPACE = " \t\n\x0b\x0c\r\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_space(c) -> Column:
    """TRIM of all white space; Spark's own default trims spaces only."""
    return F.btrim(_c(c), F.lit(WHITE_SPACE))


def first_match(c, patterns: Sequence[tuple[str, str]], default=None,
                upper: bool = True) -> Column:
    """P-06 first-match LIKE map: [(like_pattern, label), ...] in order."""
    probe = F.upper(_c(c)) if upper else _c(c)
    out = None
    for pattern, label in patterns:
        cond = probe.like(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    fallback = default if isinstance(default, Column) else F.lit(default)
    return fallback if out is None else out.otherwise(fallback)


def code_map(c, mapping: Mapping[str, str]) -> Column:
    """P-07 code -> label, unknown codes pass through unchanged."""
    c = _c(c)
    out = None
    for code, label in mapping.items():
        out = F.when(c == code, F.lit(label)) if out is None else out.when(c == code, F.lit(label))
    return c if out is None else out.otherwise(c)


def nested_replace(c, pairs: Iterable[tuple[str, str]]) -> Column:
    """O-05 REPLACE(REPLACE(c, a, b), ...): substring replacement in order."""
    out = _c(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
