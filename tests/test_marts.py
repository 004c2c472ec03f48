import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from wharf.operators.allocate import allocate, map_join
from wharf.operators.anchors import AnchorSpec, anchor_dates
from wharf.operators.reshape import data_as_of, unpivot_notnull
from wharf.plans import views


def test_allocate_shares_and_other(spark):
    facts = spark.createDataFrame([(1, Decimal("100.00")), (2, Decimal("100.00"))], "k int, amt decimal(18,2)")
    shares = spark.createDataFrame([(1, "A", Decimal("0.6")), (1, "B", Decimal("0.4"))],
                                   "k int, seg string, pct decimal(10,6)")
    for pre in (True, False):
        out = allocate(facts, shares, [("k", "k")], {"amt": F.col("amt")}, ["seg_out"], "pct",
                       labels={"seg_out": "seg"}, preaggregate=pre)
        got = {r.seg_out: r.amt for r in out.collect()}
        assert got == {"A": Decimal("60"), "B": Decimal("40"), "Other": Decimal("100")}


def test_map_join_inflates_unless_deduped(spark):
    facts = spark.createDataFrame([("m", "u", 5)], "MarketNm string, MarketUnitNm string, x int")
    mapping = spark.createDataFrame([("m", "u", "Y"), ("m", "u", "NC"), ("m", "u", "N")],
                                    "market string, market_unit string, Flag string")
    on = [("MarketNm", "market"), ("MarketUnitNm", "market_unit")]
    assert map_join(facts, mapping, on, F.col("Flag").isin("Y", "NC")).count() == 2
    assert map_join(facts, mapping, on, F.col("Flag").isin("Y", "NC"), dedupe_right=True).count() == 1


def test_unpivot_drops_nulls_and_relabels(spark):
    df = spark.createDataFrame([("FY24Q1", 1, None, 3)], "Quarter string, Stronger_pcnt int, same_pcnt int, weaker_pcnt int")
    out = unpivot_notnull(df, ["Quarter"], ["Stronger_pcnt", "same_pcnt", "weaker_pcnt"],
                          relabel=views.VIEW2_RELABEL).collect()
    assert sorted(r.Attribute for r in out) == ["Stronger", "weaker"]


def test_view2_quarter_flag(spark):
    rows = [(q, 1, 2, 3, qn, "x") for q in ("FY24Q1", "FY23Q1", "FY23Q4") for qn in ("Q1", "Q2")]
    dcs = spark.createDataFrame(rows, "Quarter string, Stronger_pcnt int, same_pcnt int, weaker_pcnt int, "
                                      "Question_num string, DataAsOf string")
    out = views.view2_unpivot_flag(dcs).where("Attribute = 'weaker' AND Question_num = 'Q1'").collect()
    assert {r.Quarter: r.Flag for r in out} == {"FY24Q1": 1, "FY23Q1": 2, "FY23Q4": None}


def test_view10_leap_day(spark):
    trend = spark.createDataFrame([(dt.date(2024, 2, 29), 1.0, "m", "x"), (dt.date(2023, 2, 28), 2.0, "m", "x"),
                                   (dt.date(2023, 3, 1), None, "m", "x")],
                                  "Date_1 date, Suspension_unassigned_pcnt double, Market string, DataAsOf string")
    dim = spark.createDataFrame([("m", 7)], "market_description string, market_dim_key int")
    got = {r.Date_1: r.YOYFlag for r in views.view10_yoy_flag(trend, dim).collect()}
    assert got[dt.date(2024, 2, 29)] == 1 and got[dt.date(2023, 2, 28)] == 2 and got[dt.date(2023, 3, 1)] is None


def test_data_as_of_labels(spark):
    a = spark.createDataFrame([(20240831,), (20240115,)], "datekey bigint")
    b = spark.createDataFrame([(None,)], "datekey bigint")
    f = spark.createDataFrame([("FY24Q1",), ("FY23Q4",)], "FYQ string")
    out = {r.View_name: r.Data_as_of for r in data_as_of(
        {"a": (a, F.col("datekey"), "datekey"), "b": (b, F.col("datekey"), "datekey"),
         "f": (f, F.col("FYQ"), "fyq")}).collect()}
    assert out == {"a": "End Of Aug 2024", "b": None, "f": "Q1 Of 2024"}


def test_anchor_dates_small(spark):
    rows = [(20240831, "ME", "FY24Q4"), (20240731, "ME", "FY24Q4"), (20240531, "ME", "FY24Q3"),
            (20240229, "ME", "FY24Q2"), (20240228, "WK", "FY24Q2"), (20230831, "ME", "FY23Q4"),
            (20200904, "WK", "FY20Q4"), (20230930, "ME", "FY24Q1"), (20221231, "ME", "FY23Q2")]
    facts = spark.createDataFrame(rows, "Datekey bigint, PeriodCd string, QuarterClosed string")
    got = sorted(r.Datekey for r in anchor_dates(facts, AnchorSpec()).collect())
    # newest ME; 3/6/12 months back; FY(24)-1 '09'; (2024-1) '08'; fixed literal; FY-1 and FY-2 '12'
    assert got == [20200904, 20221231, 20230831, 20230930, 20240229, 20240531, 20240831]


def test_publish_views_as_temp_views(spark):
    plan = spark.createDataFrame([("m", "u", 2024, 1, 2.0, 3.0, 4.0, 5.0, 6, 7)],
                                 "Market string, MU string, Year int, New_Bookings int, Revenue double, "
                                 "CCI double, BD double, CI double, MU_Key int, MUCG_Key int")
    names = views.publish(spark, {"fy_plan_vw": ("view3", (plan,))})
    assert names == ["fy_plan_vw"]
    assert spark.sql("SELECT count(*) AS n FROM fy_plan_vw").collect()[0].n == 1
