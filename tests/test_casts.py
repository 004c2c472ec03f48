import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wharf.functions import casts, periods


def col_values(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {dtype}")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_safe_numeric(spark):
    got = col_values(spark, ["12.5", " 1e3 ", "95%", "", "1,234", None], casts.safe_numeric)
    assert got == [Decimal("12.5"), Decimal("1000"), None, None, None, None]


def test_int_from_numeric_rounds_half_away_from_zero(spark):
    assert col_values(spark, ["2.5", "-2.5", "2.4"], casts.int_from_numeric) == [3, -3, 2]
    assert col_values(spark, ["2.5", "x", None], casts.safe_int) == [3, None, None]
    assert col_values(spark, ["2.5", "-2.5"], casts.int_from_float_round) == [3, -3]


def test_percent_numeric(spark):
    assert col_values(spark, ["95.5%", "95.5"], casts.percent_numeric) == [Decimal("95.5")] * 2


@pytest.mark.parametrize("tz", ["UTC", "America/New_York"])
def test_wall_and_utc_datetime(spark, tz):
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        s = ["2024-11-01T08:30:00.000-05:00", "2024-11-03T06:30:00Z", "2024-11-01T08:30:00", "bad", None]
        assert col_values(spark, s, casts.wall_datetime)[:3] == [
            dt.datetime(2024, 11, 1, 8, 30), dt.datetime(2024, 11, 3, 6, 30), dt.datetime(2024, 11, 1, 8, 30)]
        assert col_values(spark, s, casts.utc_datetime) == [
            dt.datetime(2024, 11, 1, 13, 30), dt.datetime(2024, 11, 3, 6, 30),
            dt.datetime(2024, 11, 1, 8, 30), None, None]
        assert col_values(spark, ["Nov 1, 2024 8:05:09 PM", "bad"], casts.reformat_us_timestamp) == [
            "11/01/2024 08:05:09 PM", None]
        assert col_values(spark, ["05-January-2024 02:30PM"], casts.parse_day_month_name) == [
            dt.datetime(2024, 1, 5, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dates(spark):
    assert col_values(spark, ["1/5/2024", "12/31/2023"], casts.parse_mdy) == [
        dt.date(2024, 1, 5), dt.date(2023, 12, 31)]
    assert col_values(spark, ["January 2024", "bad"], casts.month_name_first_day) == [dt.date(2024, 1, 1), None]
    assert col_values(spark, [20240229], casts.datekey_to_date, "bigint") == [dt.date(2024, 2, 29)]


def test_normalisers(spark):
    assert col_values(spark, ["", None, "x"], casts.blank_default) == ["blank", "blank", "x"]
    assert col_values(spark, ["  ", None, " q "], casts.normalize_blank_to_empty) == ["", "", "q"]
    groups = (("%CMT%", "Communications"), ("%PRD%", "Products"))
    assert col_values(spark, ["cmt-prd", "PRD", "zzz"], lambda c: casts.first_match(c, groups, "blank")) == [
        "Communications", "Products", "blank"]
    assert col_values(spark, ["C", "O", "Q"], lambda c: casts.code_map(c, {"C": "Consulting", "O": "Outsourcing"})) == [
        "Consulting", "Outsourcing", "Q"]


def test_period_labels(spark):
    assert col_values(spark, ["20240831", None, "20241399"], periods.data_as_of_label) == [
        "End Of Aug 2024", None, None]
    assert col_values(spark, ["FY24Q1"], periods.fyq_as_of_label) == ["Q1 Of 2024"]
    assert col_values(spark, ["FY24Q1", "FY10Q3"], periods.prior_year_label) == ["FY23Q1", "FY9Q3"]
    d = [dt.date(2023, 12, 15), dt.date(2024, 3, 1), dt.date(2024, 4, 1)]
    got = col_values(spark, d, lambda c: periods.fiscal_slot_label(c, periods.quarter_slot(F.lit(9))), "date")
    assert got == ["FY24Q2-M2", "FY24Q3-M2", None]
    assert col_values(spark, [dt.date(2023, 9, 1), dt.date(2024, 8, 31)],
                      lambda c: periods.quarter_label(c, "FY", 9), "date") == ["FY24Q1", "FY24Q4"]


@pytest.mark.parametrize("tz", ["UTC", "America/New_York"])
def test_wall_formatting_is_zone_free(spark, tz):
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 5),)], "t timestamp_ntz")
        row = df.select(casts.format_wall(F.col("t"), "MM/dd/yyyy hh:mm:ss a").alias("a"),
                        casts.format_wall(F.col("t"), "dd-MMMM-yyyy HH:mm").alias("b"),
                        casts.format_wall(F.col("t"), "MMM d, yyyy h:mm:ss a").alias("c")).collect()[0]
        assert (row.a, row.b, row.c) == ("03/10/2024 02:30:05 AM", "10-March-2024 02:30",
                                         "Mar 10, 2024 2:30:05 AM")
        # a wall time inside New York's spring-forward gap survives the T-10 round trip
        assert col_values(spark, ["Mar 10, 2024 2:30:00 AM"], casts.reformat_us_timestamp) == [
            "03/10/2024 02:30:00 AM"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_session_without_explicit_time_zone(spark):
    spark.conf.unset("spark.sql.session.timeZone")
    try:
        got = col_values(spark, ["2024-11-01T08:30:00.000-05:00"], casts.utc_datetime)
        assert got == [dt.datetime(2024, 11, 1, 13, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
