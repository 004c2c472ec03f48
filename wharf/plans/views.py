"""The reference's ten reporting views (M-04..M-13) as DataFrame functions.

Inputs carry the reference's column names. One-row CTEs are scalar
subqueries (see ``operators.flags``); dimension joins are LEFT joins to a
DISTINCT projection whose strategy AQE picks from the measured size.
"""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharf.functions import casts
from wharf.functions.periods import prior_year_label
from wharf.operators.flags import first_match_flag, scalar
from wharf.operators.reshape import dim_lookup, unpivot_notnull

# View 1's measure columns (source name, output name).
VIEW1_MEASURES = (
    ("mtd_curr_chg", "Curr_Chg"), ("mtd_official_target", "Official_Target"),
    ("mtd_var_target_chg", "Var_Target_Chg"), ("mtd_standard_available_hrs", "Standard_Available_Hrs"),
    ("mtd_prev_chg", "Prev_Chg"), ("mtd_var_prev_chg", "Var_Prev_Chg"), ("mtd_delta", "Delta"),
    ("mtd_chg_hrs", "Chg_Hrs"), ("mtd_curr_external_chg", "Curr_External_Chg"),
    ("mtd_prev_external_chg", "Prev_External_Chg"),
    ("mtd_var_prev_external_chg", "Var_Prev_External_Chg"),
    ("mtd_external_chg_hrs", "External_Chg_Hrs"),
    ("mtd_var_monetized_chg", "MTD_Var_Monetized_Chg"),
    ("mtd_monetized_chg_gap_fte", "MTD_Monetized_Chg_Gap_FTE"),
)
# View 2's attribute relabels and view 4's, in order.
VIEW2_RELABEL = (("Stronger_pcnt", "Stronger"), ("same_pcnt", "The Same"), ("weaker_pcnt", "weaker"))
VIEW4_RELABEL = (("Major Banks", "Banks"),)


def view1_safe_cast(fact: DataFrame) -> DataFrame:
    """M-04 / P-01: rename + SAFE_CAST AS NUMERIC projection."""
    return fact.select(
        "Date_1", "Entity_Level_1", "Entity_Level_2", "entity_level_3",
        F.col("MTD_FTE").alias("FTE"),
        *[casts.safe_numeric(F.col(src)).alias(out) for src, out in VIEW1_MEASURES],
        "Market", "Entity_key")


def view2_unpivot_flag(dcs: DataFrame) -> DataFrame:
    """M-05: UNPIVOT 3 shares (NULLs dropped), relabel, weaker-Q1 quarter flag (X-03)."""
    qtr = scalar(dcs, F.max("Quarter"))
    a = unpivot_notnull(dcs.select("Quarter", "Stronger_pcnt", "same_pcnt", "weaker_pcnt",
                                   "Question_num", "DataAsOf"),
                        ["Quarter", "Question_num", "DataAsOf"],
                        ["Stronger_pcnt", "same_pcnt", "weaker_pcnt"],
                        "Attribute", "Value", VIEW2_RELABEL)
    q = F.col("Quarter")
    base = (F.col("Attribute") == "weaker") & (F.col("Question_num") == "Q1")
    flag = first_match_flag([(base & (q == qtr), 1), (base & (q == prior_year_label(qtr, "FY")), 2)])
    return a.select("Quarter", "Attribute", "Value", "Question_num", "DataAsOf",
                    flag.cast("int").alias("Flag"))


def view3_projection(plan: DataFrame) -> DataFrame:
    """M-06 / P-02."""
    return plan.select("Market", "MU", "Year", "New_Bookings", "Revenue", "CCI", "BD", "CI",
                       "MU_Key", "MUCG_Key")


def view4_year_flag(gdp: DataFrame, market_dim: DataFrame) -> DataFrame:
    """M-07 / X-05: flag 1..4 by (Type, Current_Prev) at the max year; market key."""
    maxyear = scalar(gdp, F.max("Year"))
    y, t, cp = F.col("Year"), F.col("Type"), F.col("Current_Prev")
    at_max = y == maxyear
    flag = first_match_flag([
        (at_max & (t == "GDP") & (cp == "Current"), 1),
        (at_max & (t == "GDP") & (cp == "Prior"), 2),
        (at_max & (t == "Inflation") & (cp == "Current"), 3),
        (at_max & (t == "Inflation") & (cp == "Prior"), 4),
    ])
    a = gdp.select("Type", "Current_Prev", "Market",
                   casts.nested_replace(F.col("Attribute"), VIEW4_RELABEL).alias("Attribute"),
                   "Average", "DataAsOf",
                   F.concat(F.lit("CY"), y.cast("string")).alias("Year"),
                   flag.cast("int").alias("Flag"))
    return dim_lookup(a, market_dim, F.col("Market"), "Market_Description", ["market_dim_key"])


def view5_guidance_flag(guidance: DataFrame) -> DataFrame:
    """M-08 / X-04: two independent maxima over non-null values; CY year-over-year."""
    valued = guidance.where(F.col("Value").isNotNull())
    tops = scalar(valued, F.struct(F.max("label").alias("lbl"), F.max("Quarter").alias("qtr")))
    lbl, qtr = tops["lbl"], tops["qtr"]
    at_lbl = F.col("label") == lbl
    flag = first_match_flag([(at_lbl & (F.col("Quarter") == qtr), 1),
                             (at_lbl & (F.col("Quarter") == prior_year_label(qtr, "CY")), 2)])
    return valued.select("label", "Quarter", "Value", flag.cast("int").alias("YoYflag"), "DataAsOf")


def view6_max_year_flag(outlook: DataFrame) -> DataFrame:
    """M-09 / X-06."""
    maxyear = scalar(outlook, F.max("CY"))
    flag = first_match_flag([(F.col("CY") == maxyear, 1)])
    return outlook.select("CY", "Label", "Prior_Forecast", "Current_Forecast", "QoQ", "DataAsOf",
                          flag.cast("int").alias("Flag"))


def view7_mom_flag(layoffs: DataFrame, market_dim: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """M-10 / X-07: month of the newest parsed date and max year; prior month -> 2.

    ``dates``: a table with the same Date and year values (default: ``layoffs``), for
    callers whose layoffs are a join that need not run twice for two maxima.
    """
    parsed = casts.parse_day_month_name(F.col("Date"))
    tops = scalar(layoffs if dates is None else dates, F.struct(F.month(F.max(parsed)).alias("m"), F.max("year").alias("y")))
    maxmonth, maxyear = tops["m"], tops["y"]
    m = F.month(parsed)
    at_year = F.col("year") == maxyear
    flag = first_match_flag([(at_year & (m == maxmonth), 1), (at_year & (m == maxmonth - 1), 2)])
    a = layoffs.select("Primary_Market", parsed.alias("date"), "count",
                       flag.cast("int").alias("MoMFlag"), "DataAsOf")
    out = dim_lookup(a, market_dim, casts.trim_space("Primary_Market"), "market_description",
                     ["market_dim_key"])
    return out.select("Primary_Market", "market_dim_key", "date", "count", "MoMFlag", "DataAsOf")


def view8_projection(wins: DataFrame) -> DataFrame:
    """M-11 / P-02."""
    return wins.select("ServiceGroup", "Market", "Wins", "Small_Wins", "Large_Wins", "Mega_Wins")


def view9_lookback_flag(prices: DataFrame, date_dim: DataFrame,
                        window_prices: DataFrame | None = None) -> DataFrame:
    """M-12 / X-08: '1' newest date, '2'/'3'/'4' first date of the 7/30/90-day windows.

    The reference reads the 30-day window's dates from another dataset;
    ``window_prices`` (default: ``prices``) plays that role.
    """
    window_prices = prices if window_prices is None else window_prices
    d = F.col("date")
    maxdate = scalar(prices, F.max("date"))

    def first(src: DataFrame, back_to, back_from):
        return scalar(src, F.min(F.when((d <= back_from) & (d >= back_to), d)))

    m7 = first(prices, F.date_sub(maxdate, 7), F.date_sub(maxdate, 3))
    m30 = first(window_prices, F.add_months(maxdate, -1), F.date_sub(maxdate, 23))
    m90 = first(prices, F.add_months(maxdate, -3), F.date_sub(maxdate, 80))
    flag = first_match_flag([(d == maxdate, "1"), (d == m7, "2"), (d == m30, "3"), (d == m90, "4")])
    a = prices.where(d.cast("string").isNotNull()).select("date", "SP500_Price", flag.alias("Flag"))
    out = dim_lookup(a, date_dim.withColumn("__full", casts.parse_mdy(F.col("fulldate"))),
                     F.col("date"), "__full", ["datekey"])
    return out.select("date", "SP500_Price", "datekey", "Flag")


def view10_yoy_flag(trend: DataFrame, market_dim: DataFrame) -> DataFrame:
    """M-13 / X-09: newest date over non-null values -> 1, one year earlier -> 2."""
    valued = trend.where(F.col("Suspension_unassigned_pcnt").isNotNull())
    maxdate = scalar(valued, F.max("Date_1"))
    mindate = F.add_months(maxdate, -12)
    d = F.col("Date_1")
    flag = first_match_flag([(d == maxdate, 1), (d == mindate, 2)])
    a = trend.select("Date_1", "Suspension_unassigned_pcnt", "Market",
                     flag.cast("int").alias("YOYFlag"), "DataAsOf")
    out = dim_lookup(a, market_dim, F.col("Market"), "market_description", ["market_dim_key"])
    return out.select("Date_1", "Suspension_unassigned_pcnt", "Market", "YOYFlag",
                      "market_dim_key", "DataAsOf")


VIEWS = {
    "view1": view1_safe_cast, "view2": view2_unpivot_flag, "view3": view3_projection,
    "view4": view4_year_flag, "view5": view5_guidance_flag, "view6": view6_max_year_flag,
    "view7": view7_mom_flag, "view8": view8_projection, "view9": view9_lookback_flag,
    "view10": view10_yoy_flag,
}


def publish(spark, tables: dict[str, tuple[str, tuple[DataFrame, ...]]]) -> list[str]:
    """S-08 publish views: {view_name: (registry key, inputs)} -> temp views."""
    names = []
    for name, (key, inputs) in tables.items():
        VIEWS[key](*inputs).createOrReplaceTempView(name)
        names.append(name)
    return names


#: Views that read other views or tables by name: {name: (registry key, names of its inputs)}.
ViewGraph = dict[str, tuple[str, tuple[str, ...]]]


def publication_order(graph: ViewGraph, changed: set[str] | None = None) -> list[str]:
    """S-08 the views to publish, inputs first: all, or those that a changed input reaches.

    A cycle raises ``graphlib.CycleError``.
    """
    order = [n for n in TopologicalSorter({v: set(ins) for v, (_, ins) in graph.items()}).static_order() if n in graph]
    if changed is None:
        return order
    reached = set(changed)
    for name in order:
        if reached.intersection(graph[name][1]):
            reached.add(name)
    return [n for n in order if n in reached]


def publish_graph(spark, graph: ViewGraph, changed: set[str] | None = None) -> list[str]:
    """S-08 publish the views of a graph over tables and views that the session knows by name."""
    names = publication_order(graph, changed)
    for name in names:
        key, inputs = graph[name]
        publish(spark, {name: (key, tuple(spark.table(i) for i in inputs))})
    return names
