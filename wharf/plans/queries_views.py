"""Registered queries for the reporting views, freshness tables and the
remaining scalar/relational operators (D-07..D-11, D-16..D-27), each with a
DuckDB oracle. Adapters map the generated tables onto the views' inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.functions import casts
from wharf.functions.periods import quarter_label
from wharf.operators.dedup import duplicates
from wharf.operators.reshape import data_as_of, dim_lookup, kpi_freshness
from wharf.plans import views
from wharf.plans.opportunity import reporting_status_date
from wharf.plans.queries_marts import OPP_SQL, _fy, _rd
from wharf.plans.testdata import _reporting_date, dec2, opportunity_snapshot, table
from wharf.session import delete_at_exit, scratch_path, shared_folder
from wharf.sources.footers import footer_reader, for_maxima, partition_values
from wharf.sources.layers import read_shards, union_shards


def _orders_geo(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (o.join(c, o["o_custkey"] == c["c_custkey"])
             .join(n, c["c_nationkey"] == n["n_nationkey"])
             .join(r, n["n_regionkey"] == r["r_regionkey"]))


def _rd_col() -> Column:
    return _reporting_date(F.col("o_orderdate"))


def _as_of() -> Column:
    return F.max(_rd_col().cast("date")).cast("string").alias("DataAsOf")


def _region_dim(spark: SparkSession, sf: str, desc: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_name").alias(desc),
                                             F.col("r_regionkey").cast("bigint").alias("market_dim_key"))


_GEO_SQL = ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
            " JOIN region ON n_regionkey = r_regionkey")
_ASOF_SQL = f"CAST(max(CAST({_rd()} AS DATE)) AS VARCHAR) AS DataAsOf"


# --------------------------------------------------------------------------- D-07 view 5
def guidance_input(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("label"),
                      quarter_label(_rd_col(), "CY", 1).alias("Quarter"))
             .agg(F.sum(F.when(F.col("o_orderstatus") != "P", dec2(F.col("o_totalprice")))).cast("decimal(18,2)")
                  .alias("Value"), _as_of()))


def d07_period_flag_qoq(spark, sf):
    return views.view5_guidance_flag(guidance_input(spark, sf))


D07_SQL = f"""
WITH g AS (
  SELECT o_orderpriority AS label,
         'CY' || right(CAST(year({_rd()}) AS VARCHAR), 2) || 'Q' || CAST(quarter({_rd()}) AS VARCHAR) AS Quarter,
         CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS Value,
         {_ASOF_SQL}
  FROM orders GROUP BY 1, 2),
t AS (SELECT max(label) AS lbl, max(Quarter) AS Qtr FROM g WHERE Value IS NOT NULL)
SELECT label, Quarter, Value,
       CASE WHEN label = t.lbl AND Quarter = t.Qtr THEN 1
            WHEN label = t.lbl AND Quarter = 'CY' || CAST(CAST(substr(t.Qtr, 3, 2) AS INT) - 1 AS VARCHAR) || right(t.Qtr, 2) THEN 2
       END AS YoYflag, DataAsOf
FROM g, t WHERE Value IS NOT NULL
"""


# --------------------------------------------------------------------------- D-08 view 9
def sp500_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    d = F.col("ts").cast("date")
    prices = e.groupBy(d.alias("date")).agg(F.sum(dec2(F.col("value"))).cast("decimal(18,2)").alias("SP500_Price"))
    dim = e.select(d.alias("d")).distinct().select(
        casts.format_wall(F.col("d"), "yyyyMMdd").cast("bigint").alias("datekey"),
        casts.format_wall(F.col("d"), "MM/dd/yyyy").alias("fulldate"))
    return prices, dim


def d08_lookback_price_flag(spark, sf):
    prices, dim = sp500_input(spark, sf)
    return views.view9_lookback_flag(prices, dim).withColumn("date", F.col("date").cast("string"))


D08_SQL = """
WITH daily AS (
  SELECT CAST(ts AS DATE) AS on_day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS price
  FROM events WHERE ts IS NOT NULL GROUP BY ALL),
aged AS (SELECT on_day, max(on_day) OVER () AS newest FROM daily),
spans(mark, reach, gap) AS (
  VALUES ('2', INTERVAL 7 DAY, INTERVAL 3 DAY), ('3', INTERVAL 1 MONTH, INTERVAL 23 DAY),
         ('4', INTERVAL 3 MONTH, INTERVAL 80 DAY)),
marks AS (
  SELECT '1' AS mark, max(newest) AS on_day FROM aged
  UNION ALL
  SELECT mark, min(on_day) FROM aged JOIN spans ON on_day BETWEEN newest - reach AND newest - gap GROUP BY mark)
SELECT strftime(on_day, '%Y-%m-%d') AS date, price AS SP500_Price,
       CAST(strftime(on_day, '%Y%m%d') AS BIGINT) AS datekey,
       (SELECT min(mark) FROM marks WHERE marks.on_day = daily.on_day) AS Flag
FROM daily
"""


# --------------------------------------------------------------------------- D-09 view 10
def trend_input(spark: SparkSession, sf: str) -> DataFrame:
    g = _orders_geo(spark, sf)
    hot = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    return (g.groupBy(F.trunc(_rd_col(), "month").alias("Date_1"), F.col("r_name").alias("Market"))
             .agg(F.sum(F.when(hot, dec2(F.col("o_totalprice")))).cast("decimal(18,2)")
                  .alias("Suspension_unassigned_pcnt"), _as_of()))


def d09_yoy_flag(spark, sf):
    out = views.view10_yoy_flag(trend_input(spark, sf), _region_dim(spark, sf, "market_description"))
    return out.withColumn("Date_1", F.col("Date_1").cast("string"))


D09_SQL = f"""
SELECT strftime(month_start, '%Y-%m-%d') AS Date_1, urgent AS Suspension_unassigned_pcnt, r_name AS Market,
       CASE date_diff('month', month_start, max(month_start) FILTER (WHERE urgent IS NOT NULL) OVER ())
            WHEN 0 THEN 1 WHEN 12 THEN 2 END AS YOYFlag,
       (SELECT CAST(any_value(r_regionkey) AS BIGINT) FROM region WHERE region.r_name = monthly.r_name) AS market_dim_key,
       DataAsOf
FROM (
  SELECT CAST(date_trunc('month', {_rd()}) AS DATE) AS month_start, r_name, {_ASOF_SQL},
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
              FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS DECIMAL(18,2)) AS urgent
  FROM {_GEO_SQL} GROUP BY month_start, r_name) monthly
"""


# --------------------------------------------------------------------------- D-10 view 7
def _layoff_date() -> Column:
    ts = F.timestamp_add("HOUR", F.col("o_orderkey") % 24, _rd_col())
    return F.concat(casts.format_wall(ts, "dd-MMMM-yyyy HH:mm"),
                    F.when(F.hour(ts) < 12, F.lit("AM")).otherwise(F.lit("PM")))


def layoffs_input(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_geo(spark, sf).select(F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("Primary_Market"),
                    _layoff_date().alias("Date"), F.year(_rd_col()).alias("year"),
                    (F.col("o_custkey") % 50).alias("count"),
                    casts.format_wall(_rd_col(), "yyyy-MM-dd").alias("DataAsOf"))


def d10_mom_flag(spark, sf):
    dim = table(spark, sf, "nation").select(F.col("n_name").alias("market_description"),
                                            F.col("n_nationkey").cast("bigint").alias("market_dim_key"))
    # Every order has its customer, nation and region, so orders alone hold all dates.
    dates = table(spark, sf, "orders").select(_layoff_date().alias("Date"), F.year(_rd_col()).alias("year"))
    return views.view7_mom_flag(layoffs_input(spark, sf), dim, dates)


D10_SQL = f"""
SELECT ' ' || n_name || ' ' AS Primary_Market, on_time AS date, headcount AS count, as_of AS DataAsOf,
       (SELECT CAST(any_value(n_nationkey) AS BIGINT) FROM nation WHERE nation.n_name = notices.n_name) AS market_dim_key,
       CASE WHEN year(day) = max(year(day)) OVER ()
            THEN CASE month(max(on_time) OVER ()) - month(on_time) WHEN 0 THEN 1 WHEN 1 THEN 2 END END AS MoMFlag
FROM (
  SELECT n_name, {_rd()} AS day, CAST({_rd()} + to_hours(o_orderkey % 24) AS TIMESTAMP) AS on_time,
         o_custkey % 50 AS headcount, strftime({_rd()}, '%Y-%m-%d') AS as_of
  FROM {_GEO_SQL}) notices
"""


# --------------------------------------------------------------------------- D-11 view 2
def dcs_input(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    return (o.groupBy(quarter_label(_rd_col(), "FY", 9).alias("Quarter"),
                      F.concat(F.lit("Q"), F.substring("o_orderpriority", 1, 1)).alias("Question_num"))
             .agg(F.count_if(st == "F").alias("Stronger_pcnt"),
                  F.count_if(st == "O").alias("same_pcnt"),
                  F.nullif(F.count_if((st == "P") & (F.col("o_totalprice") > 480000)), F.lit(0))
                   .alias("weaker_pcnt"),
                  _as_of()))


def d11_unpivot_relabel(spark, sf):
    return views.view2_unpivot_flag(dcs_input(spark, sf))


D11_SQL = f"""
WITH dcs AS (
  SELECT {_fy(_rd())} AS Quarter, 'Q' || substr(o_orderpriority, 1, 1) AS Question_num,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS Stronger_pcnt,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS same_pcnt,
         NULLIF(count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 480000), 0) AS weaker_pcnt,
         {_ASOF_SQL}
  FROM orders GROUP BY 1, 2),
mq AS (SELECT max(Quarter) AS Qtr FROM dcs),
a AS (
  SELECT Quarter,
         replace(replace(replace(Attribute, 'Stronger_pcnt', 'Stronger'), 'same_pcnt', 'The Same'),
                 'weaker_pcnt', 'weaker') AS Attribute,
         Value, Question_num, DataAsOf
  FROM dcs UNPIVOT (Value FOR Attribute IN (Stronger_pcnt, same_pcnt, weaker_pcnt)))
SELECT a.Quarter, a.Attribute, a.Value, a.Question_num, a.DataAsOf,
       CASE WHEN Attribute = 'weaker' AND Quarter = mq.Qtr AND Question_num = 'Q1' THEN 1
            WHEN Attribute = 'weaker' AND Question_num = 'Q1'
             AND Quarter = 'FY' || CAST(CAST(substr(mq.Qtr, 3, 2) AS INT) - 1 AS VARCHAR) || right(mq.Qtr, 2) THEN 2
       END AS Flag
FROM a, mq
"""


# --------------------------------------------------------------------------- D-16/D-17 freshness
def freshness_probes(spark: SparkSession, sf: str) -> dict:
    o, li, e = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "events")
    conv = table(spark, sf, "conversations")
    rd = _rd_col()
    return {
        "orders_vw": (o, F.col("o_orderdate").cast("date"), "date"),
        "lineitem_vw": (li, F.col("l_shipdate").cast("date"), "date"),
        "events_vw": (e, F.col("ts").cast("date"), "date"),
        "opportunity_vw": (o, casts.format_wall(F.last_day(rd), "yyyyMMdd").cast("bigint"), "datekey"),
        "conversations_vw": (conv, F.col("conv_id") * 1000 + F.col("turn"), "datekey"),
        "industry_fyq_vw": (o, quarter_label(rd, "FY", 9), "fyq"),
    }


def d16_data_as_of(spark, sf):
    return data_as_of(freshness_probes(spark, sf))


def d16_footer_maxima(spark, sf):
    """D-16 over published tables that store their date keys, as a warehouse's tables do:
    each maximum comes from footers, the newest quarter from the partition values."""
    keys: dict[int, tuple[DataFrame, list]] = {}
    for name, (df, key, kind) in freshness_probes(spark, sf).items():
        keys.setdefault(id(df), (df, []))[1].append((name, key, kind))
    probes = {}
    for df, asked in keys.values():
        path = scratch_path(spark, "keyed")
        by = [name for name, _, kind in asked if kind == "fyq"]
        df.select(*[key.alias(name) for name, key, _ in asked]).write.partitionBy(*by).parquet(path)
        readers = for_maxima(spark, path, [name for name, _, _ in asked if name not in by])
        for name, _, kind in asked:
            stored = partition_values(footer_reader(spark, path), name) if name in by else readers[name]
            probes[name] = (stored, F.col(name), kind)
    return data_as_of(probes)


_LABEL_SQL = """CASE substr(datekey, 5, 2) WHEN '01' THEN 'Jan' WHEN '02' THEN 'Feb' WHEN '03' THEN 'Mar'
  WHEN '04' THEN 'Apr' WHEN '05' THEN 'May' WHEN '06' THEN 'Jun' WHEN '07' THEN 'Jul' WHEN '08' THEN 'Aug'
  WHEN '09' THEN 'Sep' WHEN '10' THEN 'Oct' WHEN '11' THEN 'Nov' WHEN '12' THEN 'Dec' END"""

D16_SQL = f"""
WITH u AS (
  SELECT 'orders_vw' AS View_name, replace(CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR), '-', '') AS datekey FROM orders
  UNION ALL SELECT 'lineitem_vw', replace(CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR), '-', '') FROM lineitem
  UNION ALL SELECT 'events_vw', replace(CAST(max(CAST(ts AS DATE)) AS VARCHAR), '-', '') FROM events
  UNION ALL SELECT 'opportunity_vw', CAST(max(CAST(strftime(last_day({_rd()}), '%Y%m%d') AS BIGINT)) AS VARCHAR) FROM orders
  UNION ALL SELECT 'conversations_vw', CAST(max(conv_id * 1000 + turn) AS VARCHAR) FROM conversations),
f AS (SELECT 'industry_fyq_vw' AS View_name, max({_fy(_rd())}) AS FYQ FROM orders)
SELECT View_name, datekey, 'End Of ' || ({_LABEL_SQL}) || ' ' || substr(datekey, 1, 4) AS Data_as_of
FROM u GROUP BY View_name, datekey
UNION ALL
SELECT View_name, FYQ, concat(substr(FYQ, 5, 2), ' Of ', concat('20', substr(FYQ, 3, 2))) FROM f GROUP BY 1, 2
"""


def kpi_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, sf, "region")
    view = (F.when(F.col("r_regionkey") % 3 == 0, F.lit("orders_vw"))
             .when(F.col("r_regionkey") % 3 == 1, F.lit("industry_fyq_vw")).otherwise(F.lit("missing_vw")))
    kpis = r.select(F.col("r_name").alias("data_source"),
                    F.concat(F.lit("feed_"), F.col("r_name")).alias("data_refresh_feed_source_name"),
                    F.lit("Daily").alias("data_refresh_cycle"),
                    F.concat(F.lit("kpi_"), F.col("r_regionkey").cast("string")).alias("kpi"),
                    view.alias("view"))
    # One region's feed goes by another name in the timings, so its KPI finds none.
    feed = F.when(F.col("r_name") == "MIDDLE EAST", F.lit("other_")).otherwise(F.lit("feed_"))
    timings = (_orders_geo(spark, sf)
               .groupBy(F.concat(feed, F.col("r_name")).alias("DataFeedName"))
               .agg(F.max("o_orderdate").alias("DataLoadCompletionDTM"),
                    F.timestamp_add("HOUR", F.lit(1), F.max("o_orderdate")).alias("PBICompletionDTM")))
    return kpis, timings


def d17_kpi_freshness(spark, sf):
    kpis, timings = kpi_inputs(spark, sf)
    return kpi_freshness(kpis, timings, d16_data_as_of(spark, sf))


D17_SQL = f"""
WITH dk AS ({D16_SQL}),
k AS (SELECT r_name AS data_source, 'feed_' || r_name AS data_refresh_feed_source_name, 'Daily' AS data_refresh_cycle,
             'kpi_' || CAST(r_regionkey AS VARCHAR) AS kpi,
             CASE r_regionkey % 3 WHEN 0 THEN 'orders_vw' WHEN 1 THEN 'industry_fyq_vw' ELSE 'missing_vw' END AS view
      FROM region),
t AS (SELECT CASE WHEN r_name = 'MIDDLE EAST' THEN 'other_' ELSE 'feed_' END || r_name AS DataFeedName, max(o_orderdate) AS DataLoadCompletionDTM,
             max(o_orderdate) + INTERVAL 1 HOUR AS PBICompletionDTM
      FROM {_GEO_SQL} GROUP BY 1)
SELECT k.data_source, k.data_refresh_feed_source_name, k.data_refresh_cycle, k.kpi, k.view,
       dk.Data_as_of, t.DataLoadCompletionDTM, t.PBICompletionDTM
FROM k LEFT JOIN t ON k.data_refresh_feed_source_name = t.DataFeedName
       LEFT JOIN dk ON k.view = dk.View_name
"""


# --------------------------------------------------------------------------- D-18 view 1
def chg_input(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    v = dec2(F.col("value"))
    vs = v.cast("string")
    return e.select(
        F.col("ts").cast("date").alias("Date_1"), F.col("event_type").alias("Entity_Level_1"),
        (F.col("user_id") % 10).cast("string").alias("Entity_Level_2"),
        F.col("user_id").cast("string").alias("entity_level_3"),
        F.get_json_object("props", "$.k").alias("MTD_FTE"),
        vs.alias("mtd_curr_chg"),
        F.get_json_object("props", "$.k").alias("mtd_official_target"),
        F.concat(vs, F.lit("%")).alias("mtd_var_target_chg"),
        F.lit("").alias("mtd_standard_available_hrs"),
        F.col("event_id").cast("string").alias("mtd_prev_chg"),
        F.concat(F.lit("1,"), F.col("user_id").cast("string")).alias("mtd_var_prev_chg"),
        F.concat(F.lit("-"), vs).alias("mtd_delta"),
        F.concat(F.col("user_id").cast("string"), F.lit(".125")).alias("mtd_chg_hrs"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(vs).alias("mtd_curr_external_chg"),
        (v * 2).cast("string").alias("mtd_prev_external_chg"),
        F.lit(None).cast("string").alias("mtd_var_prev_external_chg"),
        (F.col("event_id") % 1000).cast("string").alias("mtd_external_chg_hrs"),
        (v - 100).cast("string").alias("mtd_var_monetized_chg"),
        F.lit("abc").alias("mtd_monetized_chg_gap_fte"),
        F.col("event_type").alias("Market"), F.col("event_id").alias("Entity_key"))


def d18_safe_cast_view(spark, sf):
    return views.view1_safe_cast(chg_input(spark, sf)).withColumn("Date_1", F.col("Date_1").cast("string"))


_V = "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)"
_N = "TRY_CAST({} AS DECIMAL(38,9))"
D18_SQL = f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS Date_1, event_type AS Entity_Level_1,
       CAST(user_id % 10 AS VARCHAR) AS Entity_Level_2, CAST(user_id AS VARCHAR) AS entity_level_3,
       json_extract_string(props, '$.k') AS FTE,
       {_N.format(_V)} AS Curr_Chg,
       {_N.format("json_extract_string(props, '$.k')")} AS Official_Target,
       {_N.format(_V + " || '%'")} AS Var_Target_Chg,
       {_N.format("''")} AS Standard_Available_Hrs,
       {_N.format("CAST(event_id AS VARCHAR)")} AS Prev_Chg,
       {_N.format("'1,' || CAST(user_id AS VARCHAR)")} AS Var_Prev_Chg,
       {_N.format("'-' || " + _V)} AS Delta,
       {_N.format("CAST(user_id AS VARCHAR) || '.125'")} AS Chg_Hrs,
       {_N.format("CASE WHEN event_type = 'error' THEN 'n/a' ELSE " + _V + " END")} AS Curr_External_Chg,
       {_N.format("CAST(CAST(value AS DECIMAL(18,2)) * 2 AS VARCHAR)")} AS Prev_External_Chg,
       {_N.format("CAST(NULL AS VARCHAR)")} AS Var_Prev_External_Chg,
       {_N.format("CAST(event_id % 1000 AS VARCHAR)")} AS External_Chg_Hrs,
       {_N.format("CAST(CAST(value AS DECIMAL(18,2)) - 100 AS VARCHAR)")} AS MTD_Var_Monetized_Chg,
       {_N.format("'abc'")} AS MTD_Monetized_Chg_Gap_FTE,
       event_type AS Market, event_id AS Entity_key
FROM events
"""


# --------------------------------------------------------------------------- D-19 dimension lookup
def d19_dim_lookup_left(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = F.trim(F.concat(F.lit(" NATION_"), F.col("c_nationkey").cast("string"), F.lit(" ")))
    out = dim_lookup(c, n, key, "n_name", ["n_regionkey"])
    return out.select("c_custkey", "c_name", "n_regionkey")


D19_SQL = """
SELECT c_custkey, c_name, d.n_regionkey
FROM customer LEFT JOIN (SELECT DISTINCT n_name, n_regionkey FROM nation) d
  ON trim(' NATION_' || CAST(c_nationkey AS VARCHAR) || ' ') = d.n_name
"""


# --------------------------------------------------------------------------- D-20 pattern maps
NAME_GROUPS = (("%RING%", "Jewelry"), ("%BOLT%", "Hardware"), ("%WIDGET%", "Gadgets"), ("%GEAR%", "Hardware"))
TYPE_CODES = {"E": "Economy", "S": "Standard"}


def d20_pattern_map(spark, sf):
    p = table(spark, sf, "part")
    brand = (F.when(F.col("p_size") < 5, F.lit("")).when(F.col("p_size") > 45, F.lit(None))
              .otherwise(F.col("p_brand")))
    return p.select("p_partkey",
                    casts.first_match(F.col("p_name"), NAME_GROUPS, default="blank").alias("NameGroup"),
                    casts.code_map(F.substring("p_type", 1, 1), TYPE_CODES).alias("TypeCode"),
                    casts.blank_default(brand).alias("Brand"),
                    casts.normalize_blank_to_empty(F.concat(F.lit("  "), brand)).alias("TrimmedBrand"))


D20_SQL = """
WITH p AS (SELECT *, CASE WHEN p_size < 5 THEN '' WHEN p_size > 45 THEN NULL ELSE p_brand END AS b FROM part)
SELECT p_partkey,
       CASE WHEN upper(p_name) LIKE '%RING%' THEN 'Jewelry' WHEN upper(p_name) LIKE '%BOLT%' THEN 'Hardware'
            WHEN upper(p_name) LIKE '%WIDGET%' THEN 'Gadgets' WHEN upper(p_name) LIKE '%GEAR%' THEN 'Hardware'
            ELSE 'blank' END AS NameGroup,
       CASE substr(p_type, 1, 1) WHEN 'E' THEN 'Economy' WHEN 'S' THEN 'Standard' ELSE substr(p_type, 1, 1) END AS TypeCode,
       CASE WHEN b = '' OR b IS NULL THEN 'blank' ELSE b END AS Brand,
       COALESCE(NULLIF(trim('  ' || b), ''), '') AS TrimmedBrand
FROM p
"""


# --------------------------------------------------------------------------- D-21 logout reformat
def d21_logout_reformat(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", F.lit("bad")) \
            .otherwise(casts.format_wall(F.col("ts"), "MMM d, yyyy h:mm:ss a"))
    return e.select("event_id", text.alias("Logout_raw"),
                    casts.reformat_us_timestamp(text).alias("Logout"))


D21_SQL = """
WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad'
                                 ELSE strftime(ts, '%b %-d, %Y %-I:%M:%S %p') END AS Logout_raw FROM events)
SELECT event_id, Logout_raw,
       strftime(try_strptime(Logout_raw, '%b %d, %Y %I:%M:%S %p'), '%m/%d/%Y %I:%M:%S %p') AS Logout
FROM t
"""


# --------------------------------------------------------------------------- D-22 wildcard union
def d22_wildcard_union(spark, sf):
    """All shards of a table partitioned by its suffix, whatever the suffixes are (NULL too);
    the shard 'R' comes from before the tax column."""
    root = f"{shared_folder(spark)}/wharf-tables/shards-{uuid.uuid4().hex}"
    table(spark, sf, "lineitem").withColumn("shard", F.col("l_returnflag")).write.partitionBy("shard").parquet(root)
    delete_at_exit(spark, root)
    shards, old = read_shards(spark, root), F.col("shard").eqNullSafe("R")
    return union_shards([shards.where(~old), shards.where(old).drop("l_tax")])


D22_SQL = """
SELECT * REPLACE (CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS l_tax), l_returnflag AS shard
FROM lineitem
"""


# --------------------------------------------------------------------------- D-23 duplicates
def d23_duplicates_audit(spark, sf):
    return duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


D23_SQL = """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
"""


# --------------------------------------------------------------------------- D-24 views 4 and 6
def gdp_input(spark: SparkSession, sf: str) -> DataFrame:
    g = _orders_geo(spark, sf)
    seg = F.col("c_mktsegment")
    return (g.groupBy(F.when(seg.isin("AUTOMOBILE", "BUILDING", "MACHINERY"), F.lit("GDP"))
                       .otherwise(F.lit("Inflation")).alias("Type"),
                      F.when(F.month(_rd_col()) <= 6, F.lit("Current")).otherwise(F.lit("Prior")).alias("Current_Prev"),
                      F.col("r_name").alias("Market"),
                      F.when(seg == "BUILDING", F.lit("Major Banks")).otherwise(seg).alias("Attribute"),
                      F.year(_rd_col()).alias("Year"))
             .agg(F.sum(dec2(F.col("o_totalprice"))).cast("decimal(18,2)").alias("Average"), _as_of()))


def d24_year_flag(spark, sf):
    return views.view4_year_flag(gdp_input(spark, sf), _region_dim(spark, sf, "Market_Description"))


D24_SQL = f"""
WITH a AS (
  SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN 'GDP' ELSE 'Inflation' END AS Type,
         CASE WHEN month({_rd()}) <= 6 THEN 'Current' ELSE 'Prior' END AS Current_Prev,
         r_name AS Market,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Major Banks' ELSE c_mktsegment END AS Attribute,
         year({_rd()}) AS Year,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS Average, {_ASOF_SQL}
  FROM {_GEO_SQL} GROUP BY 1, 2, 3, 4, 5),
mx AS (SELECT max(Year) AS maxyear FROM a),
m AS (SELECT DISTINCT r_name AS Market_Description, CAST(r_regionkey AS BIGINT) AS market_dim_key FROM region)
SELECT Type, Current_Prev, Market, replace(Attribute, 'Major Banks', 'Banks') AS Attribute, Average, DataAsOf,
       'CY' || CAST(Year AS VARCHAR) AS Year,
       CASE WHEN Year = mx.maxyear AND Type = 'GDP' AND Current_Prev = 'Current' THEN 1
            WHEN Year = mx.maxyear AND Type = 'GDP' AND Current_Prev = 'Prior' THEN 2
            WHEN Year = mx.maxyear AND Type = 'Inflation' AND Current_Prev = 'Current' THEN 3
            WHEN Year = mx.maxyear AND Type = 'Inflation' AND Current_Prev = 'Prior' THEN 4 END AS Flag,
       m.market_dim_key
FROM a CROSS JOIN mx LEFT JOIN m ON a.Market = m.Market_Description
"""


def outlook_input(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    price = dec2(F.col("o_totalprice"))
    first_half = F.month(_rd_col()) <= 6
    prior = F.coalesce(F.sum(F.when(first_half, price)), F.lit(0)).cast("decimal(18,2)")
    current = F.coalesce(F.sum(F.when(~first_half, price)), F.lit(0)).cast("decimal(18,2)")
    return (o.groupBy(F.year(_rd_col()).alias("CY"), F.col("o_orderpriority").alias("Label"))
             .agg(prior.alias("Prior_Forecast"), current.alias("Current_Forecast"),
                  (current - prior).cast("decimal(18,2)").alias("QoQ"), _as_of()))


def d24b_max_year_flag(spark, sf):
    return views.view6_max_year_flag(outlook_input(spark, sf))


D24B_SQL = f"""
WITH a AS (
  SELECT CAST(year({_rd()}) AS INTEGER) AS CY, o_orderpriority AS Label,
         CAST(COALESCE(sum(CASE WHEN month({_rd()}) <= 6 THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS Prior_Forecast,
         CAST(COALESCE(sum(CASE WHEN month({_rd()}) > 6 THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS Current_Forecast,
         {_ASOF_SQL}
  FROM orders GROUP BY 1, 2)
SELECT CY, Label, Prior_Forecast, Current_Forecast, CAST(Current_Forecast - Prior_Forecast AS DECIMAL(18,2)) AS QoQ,
       DataAsOf, CASE WHEN CY = (SELECT max(CY) FROM a) THEN 1 END AS Flag
FROM a
"""


# --------------------------------------------------------------------------- D-25 reporting date
def d25_reporting_date(spark, sf):
    s = opportunity_snapshot(spark, sf)
    d = reporting_status_date(F.col("StatusDesc"), F.col("ExpectedContractSignDtMonth"), F.col("MonthClosed"))
    return s.select("OpportunityId", "StatusDesc", d.cast("string").alias("ReportingStatusDate"))


D25_SQL = f"""
WITH T AS ({OPP_SQL})
SELECT OpportunityId, StatusDesc,
       CAST(CASE WHEN StatusDesc = 'Unqualified' OR StatusDesc = 'Pipeline'
                 THEN CAST(try_strptime(ExpectedContractSignDtMonth, '%B %Y') AS DATE)
                 ELSE CAST(try_strptime(MonthClosed, '%B %Y') AS DATE) END AS VARCHAR) AS ReportingStatusDate
FROM T
"""


# --------------------------------------------------------------------------- D-26/D-27 views 3 and 8
def plan_input(spark: SparkSession, sf: str) -> DataFrame:
    g = _orders_geo(spark, sf)
    price = dec2(F.col("o_totalprice"))
    return (g.groupBy(F.col("r_name").alias("Market"), F.col("n_name").alias("MU"),
                      F.year(_rd_col()).alias("Year"))
             .agg(F.count_if(F.col("o_orderstatus") == "F").alias("New_Bookings"),
                  F.sum(price).cast("decimal(18,2)").alias("Revenue"),
                  F.sum(F.when(F.col("o_orderstatus") == "O", price)).cast("decimal(18,2)").alias("CCI"),
                  F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("BD"),
                  F.count(F.lit(1)).alias("CI"),
                  F.max("n_nationkey").cast("bigint").alias("MU_Key"),
                  F.max(F.col("n_nationkey") * 10 + F.col("r_regionkey")).cast("bigint").alias("MUCG_Key")))


def d26_plan_projection(spark, sf):
    return views.view3_projection(plan_input(spark, sf))


D26_SQL = f"""
SELECT r_name AS Market, n_name AS MU, CAST(year({_rd()}) AS INTEGER) AS Year,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS New_Bookings,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS Revenue,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS CCI,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BD, count(*) AS CI,
       CAST(max(n_nationkey) AS BIGINT) AS MU_Key, CAST(max(n_nationkey * 10 + r_regionkey) AS BIGINT) AS MUCG_Key
FROM {_GEO_SQL} GROUP BY 1, 2, 3
"""


def wins_input(spark: SparkSession, sf: str) -> DataFrame:
    g = _orders_geo(spark, sf)
    won = F.col("o_orderstatus") == "F"
    p = F.col("o_totalprice")
    return (g.groupBy(F.col("o_orderpriority").alias("ServiceGroup"), F.col("r_name").alias("Market"))
             .agg(F.count_if(won).alias("Wins"), F.count_if(won & (p < 100000)).alias("Small_Wins"),
                  F.count_if(won & (p >= 300000)).alias("Large_Wins"),
                  F.count_if(won & (p >= 450000)).alias("Mega_Wins")))


def d27_wins_projection(spark, sf):
    return views.view8_projection(wins_input(spark, sf))


D27_SQL = f"""
SELECT o_orderpriority AS ServiceGroup, r_name AS Market,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS Wins,
       count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice < 100000) AS Small_Wins,
       count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice >= 300000) AS Large_Wins,
       count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice >= 450000) AS Mega_Wins
FROM {_GEO_SQL} GROUP BY 1, 2
"""

# --------------------------------------------------------------------------- D-28 whole dates only
def d28_whole_dates(spark, sf):
    """T-07, T-09, P-05 on texts that a lenient cast would take: a time of day, a year, a
    month, a space for the T, a leading tab."""
    k = F.col("o_orderkey")
    ts = F.timestamp_add("HOUR", k % 24, F.col("o_orderdate"))
    iso_text, clock = casts.format_wall(ts, "yyyy-MM-dd'T'HH:mm:ss"), casts.format_wall(ts, "HH:mm")
    forms = (F.concat(iso_text, F.lit("-05:00")), clock, F.year(ts).cast("string"), casts.format_wall(ts, "yyyy-MM"),
             casts.format_wall(ts, "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("T"), clock, F.lit(":00")),
             F.concat(F.lit("\t"), iso_text))
    priority = F.when(k % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority"))
    df = table(spark, sf, "orders").select(
        k, F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("s"),
        F.concat(F.lit("\t "), priority, F.lit(" \n")).alias("p"))
    return df.select("o_orderkey", casts.wall_datetime("s").alias("wall"), casts.utc_datetime("s").alias("utc"),
                     casts.normalize_blank_to_empty(F.col("p")).alias("priority"))


D28_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + to_hours(o_orderkey % 24) END AS wall,
       CASE o_orderkey % 7 WHEN 0 THEN o_orderdate + to_hours(o_orderkey % 24 + 5)
                           WHEN 4 THEN o_orderdate + to_hours(o_orderkey % 24) END AS utc,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS priority
FROM orders
"""


QUERIES = {
    "D-07_period_flag_qoq": d07_period_flag_qoq,
    "D-08_lookback_price_flag": d08_lookback_price_flag,
    "D-09_yoy_flag": d09_yoy_flag,
    "D-10_mom_flag": d10_mom_flag,
    "D-11_unpivot_relabel": d11_unpivot_relabel,
    "D-16_data_as_of": d16_data_as_of,
    "D-16_footer_maxima": d16_footer_maxima,
    "D-17_kpi_freshness": d17_kpi_freshness,
    "D-18_safe_cast_view": d18_safe_cast_view,
    "D-19_dim_lookup_left": d19_dim_lookup_left,
    "D-20_pattern_map": d20_pattern_map,
    "D-21_logout_reformat": d21_logout_reformat,
    "D-22_wildcard_union": d22_wildcard_union,
    "D-23_duplicates_audit": d23_duplicates_audit,
    "D-24_year_flag": d24_year_flag,
    "D-24b_max_year_flag": d24b_max_year_flag,
    "D-25_reporting_date": d25_reporting_date,
    "D-26_plan_projection": d26_plan_projection,
    "D-27_wins_projection": d27_wins_projection,
    "D-28_whole_dates": d28_whole_dates,
}
ORACLES = {
    "D-07_period_flag_qoq": D07_SQL,
    "D-08_lookback_price_flag": D08_SQL,
    "D-09_yoy_flag": D09_SQL,
    "D-10_mom_flag": D10_SQL,
    "D-11_unpivot_relabel": D11_SQL,
    "D-16_data_as_of": D16_SQL,
    "D-16_footer_maxima": D16_SQL,
    "D-17_kpi_freshness": D17_SQL,
    "D-18_safe_cast_view": D18_SQL,
    "D-19_dim_lookup_left": D19_SQL,
    "D-20_pattern_map": D20_SQL,
    "D-21_logout_reformat": D21_SQL,
    "D-22_wildcard_union": D22_SQL,
    "D-23_duplicates_audit": D23_SQL,
    "D-24_year_flag": D24_SQL,
    "D-24b_max_year_flag": D24B_SQL,
    "D-25_reporting_date": D25_SQL,
    "D-26_plan_projection": D26_SQL,
    "D-27_wins_projection": D27_SQL,
    "D-28_whole_dates": D28_SQL,
}
