"""Registered queries D-12..D-15 (opportunity mart operators) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.functions.periods import fiscal_slot_label
from wharf.operators.allocate import allocate
from wharf.operators.anchors import anchor_dates, select_anchors
from wharf.plans.opportunity import (FLOAT_MEASURE, GROUP_KEYS, INDUSTRY_GROUPS, MEASURES,
                                     anchor_slot, opportunity_mart)
from wharf.plans.testdata import (dec2, market_mapping, opportunity_shares, opportunity_snapshot,
                                  table)


def d12_fiscal_label(spark: SparkSession, sf: str) -> DataFrame:
    snap = opportunity_snapshot(spark, sf)
    slot = anchor_slot(snap)
    return snap.select("OpportunityId", "Datekey",
                       fiscal_slot_label(F.col("ReportingDate"), slot).alias("Quarter_Beginning_Period"))


def d13_anchor_select(spark: SparkSession, sf: str) -> DataFrame:
    snap = opportunity_snapshot(spark, sf)
    me = snap.where(F.col("PeriodCd") == "ME")
    return (select_anchors(me, anchor_dates(snap))
            .groupBy("Datekey").agg(F.count(F.lit(1)).alias("n_rows")))


def part_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Parts larger than size 10 split 0.6 / 0.4 over two sub-segments."""
    p = table(spark, sf, "part").where(F.col("p_size") > 10)
    parts = F.array(
        F.struct(F.lit("-A").alias("sfx"), F.lit("0.6").cast("decimal(10,6)").alias("pct")),
        F.struct(F.lit("-B").alias("sfx"), F.lit("0.4").cast("decimal(10,6)").alias("pct")))
    return (p.select("p_partkey", "p_type", "p_brand", F.explode(parts).alias("x"))
             .select("p_partkey", F.concat("p_type", "x.sfx").alias("IndustrySubSegment"),
                     F.col("x.pct").alias("IndustrySubSegment_Percentage"),
                     F.col("p_type").alias("IndustrySegment"), F.col("p_brand").alias("IndustryGroup")))


def d14_allocate(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return allocate(li, part_shares(spark, sf), on=[("l_partkey", "p_partkey")],
                    measures={"revenue": dec2(F.col("l_extendedprice")),
                              "quantity": dec2(F.col("l_quantity"))},
                    group_by=["ISS_IndustryGroup", "ISS_IndustrySegment", "l_returnflag"],
                    share_col="IndustrySubSegment_Percentage",
                    labels={"ISS_IndustryGroup": "IndustryGroup",
                            "ISS_IndustrySegment": "IndustrySegment"})


def d29_wide_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """L-01 with amounts of up to 19 digits before the point."""
    amount = dec2(F.col("l_extendedprice")) * F.lit(10 ** 13).cast("decimal(14,0)")
    return allocate(table(spark, sf, "lineitem"), part_shares(spark, sf), on=[("l_partkey", "p_partkey")],
                    measures={"revenue": amount.cast("decimal(30,2)")},
                    group_by=["ISS_IndustryGroup", "l_returnflag"],
                    share_col="IndustrySubSegment_Percentage", labels={"ISS_IndustryGroup": "IndustryGroup"})


def d15_opportunity_mart(spark: SparkSession, sf: str) -> DataFrame:
    mart = opportunity_mart(opportunity_snapshot(spark, sf), opportunity_shares(spark, sf),
                            market_mapping(spark, sf))
    return mart.withColumns({c: F.col(c).cast("string") for c in ("ReportingStatusDate", "ReportingDate")})


# --------------------------------------------------------------------------- DuckDB oracles

def _rd(col: str = "o_orderdate") -> str:
    return f"({col} + INTERVAL 300 MONTH)"


def _fy(rd: str) -> str:
    return (f"'FY' || right(CAST(year({rd}) + CASE WHEN month({rd}) >= 9 THEN 1 ELSE 0 END AS VARCHAR), 2)"
            f" || 'Q' || CAST(((month({rd}) + 3) % 12) // 3 + 1 AS VARCHAR)")


def _datekey(rd: str) -> str:
    return (f"CAST(strftime(CASE WHEN o_orderpriority = '5-LOW' THEN {rd} ELSE last_day({rd}) END,"
            f" '%Y%m%d') AS BIGINT)")


_PRICE = "CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,9)) AS DECIMAL(38,9))"
_MEASURE_SQL = {src: _PRICE for src, _ in MEASURES}
_MEASURE_SQL["WorkHours"] = "CAST(c_custkey % 40 AS DECIMAL(38,9))"
_MEASURE_SQL["ContractControllableIncomeGlobalAmt"] = \
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(38,9))"

OPP_SQL = f"""
  SELECT {_datekey(_rd())} AS Datekey, o_orderkey AS OpportunityId,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'WK' ELSE 'ME' END AS PeriodCd,
         CASE WHEN o_orderstatus = 'O' THEN 'Pipeline'
              WHEN o_orderstatus = 'F' AND o_orderkey % 29 = 0 THEN 'Closed-Duplicated'
              WHEN o_orderstatus = 'F' THEN 'Won' ELSE 'Unqualified' END AS StatusDesc,
         'Stage ' || substr(o_orderpriority, 1, 1) AS StageDesc,
         {_rd()} AS ReportingDate,
         c_name AS MasterCustomerNm, CAST(c_custkey AS VARCHAR) AS MasterCustomerNbr,
         c_mktsegment AS HistoricalMasterClientClassDesc, c_mktsegment AS CurrentMasterClientClassDesc,
         r_name AS MarketNm,
         CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL ELSE n_name END AS MarketUnitNm,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cmt Auto' WHEN 'BUILDING' THEN 'res building'
              WHEN 'FURNITURE' THEN 'PRD Furniture' WHEN 'MACHINERY' THEN 'h&ps machinery' ELSE '' END AS ClientGroupNm,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE substr(c_mktsegment, 1, 2) END AS ClientGroupCd,
         c_mktsegment AS MasterCustomerIndustryNm,
         {_fy(_rd())} AS ExpectedContractSignDtFiscalQuarter,
         CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE strftime({_rd()} + INTERVAL 2 MONTH, '%B %Y') END
           AS ExpectedContractSignDtMonth,
         {_fy(_rd())} AS QuarterClosed,
         strftime({_rd()}, '%B %Y') AS MonthClosed,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'SG-' || o_orderpriority END AS ServiceGroupDesc,
         CASE WHEN o_totalprice > 300000 THEN 'Large' ELSE 'Small' END AS DealSizeStandardDesc,
         o_orderpriority AS ServicesDesc, o_orderstatus AS DealFamilyDesc,
         CASE o_orderstatus WHEN 'F' THEN 'C' WHEN 'O' THEN 'O' ELSE 'X' END AS TypeOfWorkCd,
         CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS WinRateFlag,
         'Y' AS SubServiceGroupAHRWithinRangeInd, 'N' AS SubServiceGroupHasEffortInd,
         'N' AS OpportunityExtensionInd, c_mktsegment AS CompetitionCategory,
         CASE WHEN o_totalprice > 450000 THEN 'Mega' ELSE '' END AS MegaDealDesc,
         'Y' AS QuarterSpecificInd, n_name AS CountryNm,
         r_name AS ResponsibleBusinessEntityWithOverrideNm, 'Std' AS StandardDealGroupDesc,
         {", ".join(f"{v} AS {k}" for k, v in _MEASURE_SQL.items())},
         CAST(c_custkey % 1000 AS DOUBLE) AS {FLOAT_MEASURE}
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

SHARES_SQL = f"""
  SELECT {_datekey(_rd())} AS Datekey, o_orderkey AS OpportunityId, sub AS IndustrySubSegment,
         pct AS IndustrySubSegment_Percentage, 'SEG-' || o_orderstatus AS IndustrySegment,
         'GRP-' || substr(o_orderpriority, 1, 1) AS IndustryGroup
  FROM orders, (VALUES ('SUB-A', CAST(0.75 AS DECIMAL(10,6))), ('SUB-B', CAST(0.25 AS DECIMAL(10,6)))) v(sub, pct)
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""

MAPPING_SQL = """
  SELECT r_name AS market, n_name AS market_unit, 'Y' AS Flag FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT r_name, n_name, 'NC' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'
  UNION ALL
  SELECT r_name, n_name, 'N' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"""

# X-01 slot table: month -> (slot, fiscal quarter, month in quarter, year offset).
_SLOT_VALUES = ", ".join(
    f"({m}, {m % 3 + 1}, {((m - 8) % 12) // 3 + 1}, {(m - 8) % 3 + 1}, {1 if m >= 8 else 0})"
    for m in range(1, 13))

SLOT_SQL = f"""
  SELECT CASE WHEN month(max(ReportingDate)) IN (9, 12, 3, 6) THEN 1
              WHEN month(max(ReportingDate)) IN (10, 1, 4, 7) THEN 2
              WHEN month(max(ReportingDate)) IN (11, 2, 5, 8) THEN 3 END AS newest_slot
  FROM T WHERE Datekey IN (SELECT max(Datekey) FROM T WHERE StatusDesc IN ('Pipeline') AND PeriodCd = 'ME')"""

LABEL_SQL = """CASE WHEN s.slot = (SELECT newest_slot FROM slot)
       THEN 'FY' || substr(CAST(year(ReportingDate) + s.yoff AS VARCHAR), 3) || 'Q' || s.q || '-M' || s.mq END"""

D12_SQL = f"""
WITH T AS ({OPP_SQL}), slot AS ({SLOT_SQL}),
s AS (SELECT * FROM (VALUES {_SLOT_VALUES}) v(m, slot, q, mq, yoff))
SELECT OpportunityId, Datekey, {LABEL_SQL} AS Quarter_Beginning_Period
FROM T JOIN s ON month(T.ReportingDate) = s.m
"""


def _like_month(prefix_sql: str) -> str:
    return f"(SELECT max(Datekey) FROM T WHERE CAST(Datekey AS VARCHAR) LIKE ({prefix_sql}) || '%')"


_MAXME = "(SELECT max(Datekey) FROM T WHERE PeriodCd = 'ME')"
_Q_ANY = "(SELECT max(QuarterClosed) FROM T WHERE Datekey IN (SELECT max(Datekey) FROM T))"
_Q_ME = f"(SELECT max(QuarterClosed) FROM T WHERE Datekey IN {_MAXME})"


def _back(months: int) -> str:
    return (f"substr(strftime(strptime(CAST({_MAXME} AS VARCHAR), '%Y%m%d') - INTERVAL {months} MONTH,"
            f" '%Y%m%d'), 1, 6)")


def _fyp(q: str, delta: int, mm: str) -> str:
    return f"'20' || CAST(CAST(substr({q}, -4, 2) AS BIGINT) + ({delta}) AS VARCHAR) || '{mm}'"


_ANCHORS = ["20200904", _MAXME]
_ANCHORS += [_like_month(_back(m)) for m in (3, 6, 9, 12, 24)]
_ANCHORS += [_like_month(_fyp(_Q_ANY, d, "09")) for d in (-3, -2, -1)]
_ANCHORS.append(_like_month(
    f"(SELECT DISTINCT CAST(CAST(substr(trim(CAST(Datekey AS VARCHAR)), 1, 4) AS BIGINT) - 1 AS VARCHAR)"
    f" || '08' FROM T WHERE Datekey = {_MAXME})"))
_ANCHORS += [_like_month(_fyp(_Q_ME, d, mm)) for d in (-1, 0, -2) for mm in ("12", "03", "06")]
_ANCHORS += [_like_month(_back(m)) for m in (15, 21, 18, 12)]
ANCHOR_IN = "Datekey IN (" + ",\n  ".join(_ANCHORS) + ")"

D13_SQL = f"""
WITH T AS ({OPP_SQL})
SELECT Datekey, count(*) AS n_rows FROM T
WHERE PeriodCd = 'ME' AND {ANCHOR_IN}
GROUP BY Datekey
"""

D14_SQL = """
WITH shares AS (
  SELECT p_partkey, p_type || '-A' AS sub, CAST(0.6 AS DECIMAL(10,6)) AS pct, p_type AS seg, p_brand AS grp
  FROM part WHERE p_size > 10
  UNION ALL
  SELECT p_partkey, p_type || '-B', CAST(0.4 AS DECIMAL(10,6)), p_type, p_brand FROM part WHERE p_size > 10)
SELECT CASE WHEN s.p_partkey IS NULL THEN 'Other' ELSE s.grp END AS ISS_IndustryGroup,
       CASE WHEN s.p_partkey IS NULL THEN 'Other' ELSE s.seg END AS ISS_IndustrySegment,
       l_returnflag,
       CAST(SUM(CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(24,9))
                     * CAST(COALESCE(s.pct, 1) AS DECIMAL(13,9)) AS DECIMAL(38,9))) AS DECIMAL(38,9)) AS revenue,
       CAST(SUM(CAST(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(24,9))
                     * CAST(COALESCE(s.pct, 1) AS DECIMAL(13,9)) AS DECIMAL(38,9))) AS DECIMAL(38,9)) AS quantity
FROM lineitem l LEFT JOIN shares s ON l.l_partkey = s.p_partkey
GROUP BY 1, 2, 3
"""

# Shares in tenths (6 and 4, or 10 where there is none), amounts in cents: whole numbers throughout.
D29_SQL = """
SELECT COALESCE(p_brand, 'Other') AS ISS_IndustryGroup, l_returnflag,
       CAST(SUM(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * COALESCE(tenths, 10))::HUGEINT
            * 10000000000::HUGEINT AS DECIMAL(38,9)) AS revenue
FROM lineitem LEFT JOIN (SELECT p_partkey, p_brand, unnest([6, 4]) AS tenths FROM part WHERE p_size > 10)
  ON l_partkey = p_partkey
GROUP BY 1, 2
"""

_SUMS = ",\n  ".join(
    f"CAST(SUM(CAST(CAST({src} AS DECIMAL(24,9)) * CAST(COALESCE(IndustrySubSegment_Percentage, 1)"
    f" AS DECIMAL(13,9)) AS DECIMAL(38,9))) AS DECIMAL(38,9)) AS {out}" for src, out in MEASURES)


def _blank(c: str) -> str:
    return f"CASE WHEN ({c} = '' OR {c} IS NULL) THEN 'blank' ELSE {c} END"


D15_SQL = f"""
WITH T AS ({OPP_SQL}), shares AS ({SHARES_SQL}), mapping AS ({MAPPING_SQL}), slot AS ({SLOT_SQL}),
s AS (SELECT * FROM (VALUES {_SLOT_VALUES}) v(m, slot, q, mq, yoff)),
sea AS (
  SELECT T.*, sh.IndustrySubSegment, sh.IndustrySubSegment_Percentage,
         CASE WHEN sh.OpportunityId IS NULL THEN 'Other' ELSE sh.IndustryGroup END AS ISS_IndustryGroup,
         CASE WHEN sh.OpportunityId IS NULL THEN 'Other' ELSE sh.IndustrySegment END AS ISS_IndustrySegment
  FROM T LEFT JOIN shares sh ON T.Datekey = sh.Datekey AND T.OpportunityId = sh.OpportunityId
  WHERE T.ExpectedContractSignDtMonth <> ''),
agg AS (
  SELECT {", ".join(GROUP_KEYS)},
  {_SUMS},
  SUM(CAST({FLOAT_MEASURE} AS DOUBLE) * COALESCE(CAST(IndustrySubSegment_Percentage AS DOUBLE), 1.0)) AS {FLOAT_MEASURE}
  FROM sea LEFT JOIN mapping mu ON sea.MarketNm = mu.market AND sea.MarketUnitNm = mu.market_unit
                                AND mu.Flag IN ('Y', 'NC')
  WHERE sea.StatusDesc <> 'Closed-Duplicated' AND sea.PeriodCd = 'ME'
    AND sea.{ANCHOR_IN}
  GROUP BY {", ".join(GROUP_KEYS)})
SELECT MasterCustomerNm, MasterCustomerNbr, HistoricalMasterClientClassDesc,
  CurrentMasterClientClassDesc AS CurrentMasterClientClass, Datekey,
  {_blank("MarketNm")} AS Market, {_blank("MarketUnitNm")} AS MarketUnit,
  CASE {" ".join(f"WHEN upper(ClientGroupNm) LIKE '{p}' THEN '{label}'" for p, label in INDUSTRY_GROUPS)}
       ELSE 'blank' END AS IndustryGroup,
  {_blank("MasterCustomerIndustryNm")} AS IndustrySegment,
  CAST(NULL AS TIMESTAMPTZ) AS ExpectedContractSignDt,
  ExpectedContractSignDtFiscalQuarter, QuarterClosed, MonthClosed, StatusDesc, StageDesc,
  CAST(NULL AS TIMESTAMPTZ) AS PipelineEntryDt, CAST(NULL AS TIMESTAMPTZ) AS StatusSinceDt,
  CAST(NULL AS TIMESTAMPTZ) AS ConsultingStartDt, CAST(NULL AS TIMESTAMPTZ) AS ConsultingEndDt,
  TCR, {_blank("ServiceGroupDesc")} AS ServiceGroup,
  CCI, WorkHours, WtdPipeline, ServicesRevenueGlobalExcludingBEAmt, DealSizeStandardDesc,
  TCRGlobalExcludingBEAmt, WeightedTargetMarginNumGlobalExcludingBEAmt,
  WeightedTargetMarginDenGlobalExcludingBEAmt, ServicesDesc, DealFamilyDesc,
  CASE WHEN TypeOfWorkCd = 'C' THEN 'Consulting' WHEN TypeOfWorkCd = 'O' THEN 'Outsourcing'
       ELSE TypeOfWorkCd END AS TypeOfWorkCd,
  WinRateFlag, SubServiceGroupAHRWithinRangeInd, SubServiceGroupHasEffortInd,
  {", ".join(out for _, out in MEASURES[8:])},
  (SELECT {LABEL_SQL} FROM s WHERE s.m = month(agg.ReportingDate)) AS Quarter_Beginning_Period,
  CAST(CASE WHEN StatusDesc = 'Unqualified' OR StatusDesc = 'Pipeline'
            THEN CAST(strptime(ExpectedContractSignDtMonth, '%B %Y') AS DATE)
            ELSE CAST(strptime(MonthClosed, '%B %Y') AS DATE) END AS VARCHAR) AS ReportingStatusDate,
  CAST(CAST(ReportingDate AS DATE) AS VARCHAR) AS ReportingDate,
  {FLOAT_MEASURE}, OpportunityExtensionInd, CompetitionCategory, MegaDealDesc, ClientGroupNm,
  ISS_IndustryGroup, ISS_IndustrySegment, QuarterSpecificInd, CountryNm AS Country,
  ResponsibleBusinessEntityWithOverrideNm AS service_dim, StandardDealGroupDesc,
  {_blank("ClientGroupCd")} AS ClientGroupCd
FROM agg
"""

QUERIES = {
    "D-12_fiscal_label": d12_fiscal_label,
    "D-13_anchor_select": d13_anchor_select,
    "D-14_allocate": d14_allocate,
    "D-29_wide_amounts": d29_wide_amounts,
    "D-15_opportunity_mart": d15_opportunity_mart,
}
ORACLES = {
    "D-12_fiscal_label": D12_SQL,
    "D-13_anchor_select": D13_SQL,
    "D-14_allocate": D14_SQL,
    "D-29_wide_amounts": D29_SQL,
    "D-15_opportunity_mart": D15_SQL,
}
