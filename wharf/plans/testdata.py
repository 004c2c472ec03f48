"""Adapters from the generated TPC-H-like tables to the reference's input
shapes (feed stages, snapshots, ODS targets).

Everything here is a lazy DataFrame derived from the given tables with Spark
expressions, so the work grows with the tables. Planted defects are
data-derived (key residues) and never drop rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.functions import casts
from wharf.operators.upsert import Audit
from wharf.operators.validate import AtMost, Parses, Required
from wharf.plans.feeds import FeedSpec

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixed_audit(process: str = "wharf.testdata") -> Audit:
    """Deterministic stamps so results can be compared across engines."""
    return Audit(now=F.expr("timestamp_ntz'2024-06-30 00:00:00'"), user=F.lit("wharf"),
                 process=process)


def iso(ts: Column, offset: str) -> Column:
    """'yyyy-MM-ddTHH:mm:ss' + offset (cheaper than a pattern formatter)."""
    text = F.substring(ts.cast("string"), 1, 19)
    return F.concat(F.overlay(text, F.lit("T"), 11, 1), F.lit(offset))


def dec2(c: Column) -> Column:
    return c.cast("decimal(18,2)")


# --------------------------------------------------------------------------- orders feed

ORDERS_FEED = FeedSpec(
    name="OrdersFeed",
    columns=("Cosa", "Company", "Agent", "RoutingProfile", "StartInterval", "EndInterval",
             "AgentIdleTime", "OnlineTime", "ContactsHandled"),
    types={"AgentIdleTime": "numeric", "OnlineTime": "numeric", "ContactsHandled": "int"},
    dedup_keys=("Cosa", "Company", "Agent", "RoutingProfile", "StartInterval", "EndInterval"),
    merge_keys=("Cosa", "Company", "Agent", "RoutingProfile", "StartInterval", "EndInterval"),
    rules=(Required("Cosa"), Required("Agent"), Required("RoutingProfile"),
           Required("StartInterval"), Parses("StartInterval", "datetime"),
           Required("EndInterval"), Parses("EndInterval", "datetime"),
           Parses("AgentIdleTime", "numeric"),
           Parses("OnlineTime", "numeric"),
           AtMost("OnlineTime", 1800, "OnlineTime Invalid Interval Data"),
           Parses("ContactsHandled", "int")),
    utc_columns=False,
)


def orders_stage(orders: DataFrame, price_bump: int = 0, loadable: bool = False) -> DataFrame:
    """Orders as an all-string feed stage with lineage and planted defects.

    Defects by key residue: NULL Agent (53), unparsable StartInterval (61),
    '%' in AgentIdleTime (47), fractional OnlineTime '.5' (7), non-numeric
    ContactsHandled (59). OnlineTime = floor(price / 250) exceeds 1800 for
    the most expensive orders. ``loadable``: NULL in place of text that the strict
    casts of the ODS load cannot take.
    """
    def bad(text):
        return F.lit(None).cast("string") if loadable else text
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    parent = F.when(F.col("o_orderstatus").isin("F", "O"), F.lit(3462)).otherwise(F.lit(3463))
    price = dec2(F.col("o_totalprice")) + F.lit(price_bump)
    online = F.floor(F.col("o_totalprice") / 250).cast("string")
    return orders.select(
        parent.cast("bigint").alias("ParentSystemId"),
        (parent + 2).cast("bigint").alias("SystemId"),
        F.col("o_orderstatus").alias("Cosa"),
        F.col("o_orderpriority").alias("Company"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string")).alias("Agent"),
        F.concat(F.lit("RP-"), F.substring("o_orderpriority", 1, 1)).alias("RoutingProfile"),
        F.when(k % 61 == 0, bad(F.lit("not-a-date"))).otherwise(iso(d, "+00:00")).alias("StartInterval"),
        iso(F.timestamp_add("DAY", F.lit(1), d), "+00:00").alias("EndInterval"),
        F.when(k % 47 == 0, bad(F.concat(price.cast("string"), F.lit("%"))))
         .otherwise(price.cast("string")).alias("AgentIdleTime"),
        F.when(k % 7 == 0, F.concat(online, F.lit(".5"))).otherwise(online).alias("OnlineTime"),
        F.when(k % 59 == 0, bad(F.concat(F.lit("x"), (F.col("o_custkey") % 100).cast("string"))))
         .otherwise((F.col("o_custkey") % 100).cast("string")).alias("ContactsHandled"),
        (F.year(d) - 1994).cast("bigint").alias("FileLoadAuditId"),
        k.alias("LineNum"),
        d.alias("FileEffectiveDate"),
        F.lit("loader").alias("LoadBy"),
        F.timestamp_add("DAY", F.lit(1), d).alias("LoadDate"),
        F.lit("testdata").alias("LoadProcess"),
        F.lit(False).alias("InactiveInd"),
        F.lit(None).cast("timestamp_ntz").alias("InactiveDate"),
        F.lit(None).cast("string").alias("InactiveReason"),
    )


def orders_ods_target(orders: DataFrame) -> DataFrame:
    """A typed ODS as loaded before: orders before 2000; 1999 'P' rows are inactive."""
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    parent = F.when(F.col("o_orderstatus").isin("F", "O"), F.lit(3462)).otherwise(F.lit(3463))
    inactive = (F.col("o_orderstatus") == "P") & (F.year(d) == 1999)
    legacy = F.lit("legacy")
    return orders.where(d < F.lit("2000-01-01").cast("timestamp_ntz")).select(
        parent.cast("bigint").alias("ParentSystemId"),
        (parent + 2).cast("bigint").alias("SystemId"),
        F.col("o_orderstatus").alias("Cosa"),
        F.col("o_orderpriority").alias("Company"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string")).alias("Agent"),
        F.concat(F.lit("RP-"), F.substring("o_orderpriority", 1, 1)).alias("RoutingProfile"),
        d.alias("StartInterval"),
        F.timestamp_add("DAY", F.lit(1), d).alias("EndInterval"),
        dec2(F.col("o_totalprice")).cast(casts.NUMERIC).alias("AgentIdleTime"),
        F.floor(F.col("o_totalprice") / 250).cast(casts.NUMERIC).alias("OnlineTime"),
        (F.col("o_custkey") % 100).cast("bigint").alias("ContactsHandled"),
        legacy.alias("LoadBy"), d.alias("LoadDate"), legacy.alias("LoadProcess"),
        legacy.alias("CreateBy"), d.alias("CreateDate"), legacy.alias("CreateProcess"),
        legacy.alias("UpdateBy"), d.alias("UpdateDate"), legacy.alias("UpdateProcess"),
        inactive.alias("InactiveInd"),
        F.when(inactive, F.lit("closed")).otherwise(F.lit("")).alias("InactiveReason"),
        F.lit(None).cast("timestamp_ntz").alias("InactiveDate"),
    )


# --------------------------------------------------------------------------- lineitem snapshot

LINEITEM_FEED = FeedSpec(
    name="LineitemSnapshot",
    columns=("Cosa", "Company", "Agent", "RoutingProfile", "StartInterval", "EndInterval",
             "Quantity", "ExtendedPrice", "SuppCount"),
    types={"Quantity": "numeric", "ExtendedPrice": "numeric", "SuppCount": "int"},
    dedup_keys=("Cosa", "Company", "Agent", "RoutingProfile", "StartInterval", "EndInterval"),
    merge_keys=("Cosa", "Company", "Agent", "RoutingProfile", "StartInterval", "EndInterval"),
    rules=(),
    asof_keys=("ParentSystemId", "StartInterval", "EndInterval", "Cosa", "Company", "Agent",
               "RoutingProfile"),
)


def lineitem_snapshot(lineitem: DataFrame) -> DataFrame:
    """Lineitem as an append-only feed snapshot (strings + typed lineage)."""
    s = F.col("l_shipdate")
    parent = F.when(F.col("l_linestatus") == "O", F.lit(3462)).otherwise(F.lit(3463))
    start = iso(s, "-05:00")
    return lineitem.select(
        parent.cast("bigint").alias("ParentSystemId"),
        (parent + 2).cast("bigint").alias("SystemId"),
        F.col("l_returnflag").alias("Cosa"),
        F.col("l_linestatus").alias("Company"),
        F.col("l_orderkey").cast("string").alias("Agent"),
        F.col("l_linenumber").cast("string").alias("RoutingProfile"),
        start.alias("StartInterval"),
        iso(F.timestamp_add("HOUR", F.lit(8), s), "-05:00").alias("EndInterval"),
        dec2(F.col("l_quantity")).cast("string").alias("Quantity"),
        dec2(F.col("l_extendedprice")).cast("string").alias("ExtendedPrice"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".5")).alias("SuppCount"),
        s.alias("SnapshotRowDateTime"),  # the wall time of StartInterval, stored typed
        F.col("l_suppkey").alias("FileLoadAuditId"),
        F.col("l_partkey").alias("LineNum"),
        F.timestamp_add("MINUTE", F.col("l_partkey") % 97, s).alias("FileEffectiveDate"),
        F.timestamp_add("SECOND", F.col("l_suppkey"), s).alias("CreateDate"),
        (F.col("l_discount") >= 0.1).alias("InactiveInd"),
    )


# --------------------------------------------------------------------------- opportunity snapshot

def _reporting_date(d: Column) -> Column:
    """Order date moved 25 years on, so fiscal labels are 20xx like the reference's."""
    return F.add_months(d, 300).cast("timestamp_ntz")


def opportunity_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders x customer x nation x region in the opportunity-snapshot shape.

    One row per order. Weekly ('WK', priority 5-LOW) rows carry their own
    date as Datekey, month-end ('ME') rows the last day of their month.
    """
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    df = (o.join(c, o["o_custkey"] == c["c_custkey"])
           .join(n, c["c_nationkey"] == n["n_nationkey"])
           .join(r, n["n_regionkey"] == r["r_regionkey"]))
    rd = _reporting_date(F.col("o_orderdate"))
    wk = F.col("o_orderpriority") == "5-LOW"
    k = F.col("o_orderkey")
    seg = F.col("c_mktsegment")
    status = (F.when(F.col("o_orderstatus") == "O", F.lit("Pipeline"))
               .when((F.col("o_orderstatus") == "F") & (k % 29 == 0), F.lit("Closed-Duplicated"))
               .when(F.col("o_orderstatus") == "F", F.lit("Won"))
               .otherwise(F.lit("Unqualified")))
    price = dec2(F.col("o_totalprice")).cast(casts.NUMERIC)
    from wharf.functions.periods import quarter_label
    from wharf.plans.opportunity import FLOAT_MEASURE, MEASURES
    measures = {src: price for src, _ in MEASURES}
    measures["WorkHours"] = (F.col("c_custkey") % 40).cast(casts.NUMERIC)
    measures["ContractControllableIncomeGlobalAmt"] = (dec2(F.col("o_totalprice"))
                                                       * F.lit("0.25").cast("decimal(3,2)")).cast(casts.NUMERIC)
    return df.select(
        casts.format_wall(F.when(wk, rd).otherwise(F.last_day(rd)), "yyyyMMdd").cast("bigint").alias("Datekey"),
        k.alias("OpportunityId"),
        F.when(wk, F.lit("WK")).otherwise(F.lit("ME")).alias("PeriodCd"),
        status.alias("StatusDesc"),
        F.concat(F.lit("Stage "), F.substring("o_orderpriority", 1, 1)).alias("StageDesc"),
        rd.alias("ReportingDate"),
        F.col("c_name").alias("MasterCustomerNm"),
        F.col("c_custkey").cast("string").alias("MasterCustomerNbr"),
        seg.alias("HistoricalMasterClientClassDesc"),
        seg.alias("CurrentMasterClientClassDesc"),
        F.col("r_name").alias("MarketNm"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(""))
         .when(F.col("c_custkey") % 13 == 0, F.lit(None))
         .otherwise(F.col("n_name")).alias("MarketUnitNm"),
        F.when(seg == "AUTOMOBILE", F.lit("Cmt Auto")).when(seg == "BUILDING", F.lit("res building"))
         .when(seg == "FURNITURE", F.lit("PRD Furniture")).when(seg == "MACHINERY", F.lit("h&ps machinery"))
         .otherwise(F.lit("")).alias("ClientGroupNm"),
        F.when(seg == "HOUSEHOLD", F.lit(None)).otherwise(F.substring(seg, 1, 2)).alias("ClientGroupCd"),
        seg.alias("MasterCustomerIndustryNm"),
        quarter_label(rd, "FY", 9).alias("ExpectedContractSignDtFiscalQuarter"),
        F.when(k % 31 == 0, F.lit("")).otherwise(casts.format_wall(F.add_months(rd, 2), "MMMM yyyy"))
         .alias("ExpectedContractSignDtMonth"),
        quarter_label(rd, "FY", 9).alias("QuarterClosed"),
        casts.format_wall(rd, "MMMM yyyy").alias("MonthClosed"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("SG-"), F.col("o_orderpriority")))
         .alias("ServiceGroupDesc"),
        F.when(F.col("o_totalprice") > 300000, F.lit("Large")).otherwise(F.lit("Small"))
         .alias("DealSizeStandardDesc"),
        F.col("o_orderpriority").alias("ServicesDesc"),
        F.col("o_orderstatus").alias("DealFamilyDesc"),
        F.when(F.col("o_orderstatus") == "F", F.lit("C")).when(F.col("o_orderstatus") == "O", F.lit("O"))
         .otherwise(F.lit("X")).alias("TypeOfWorkCd"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Y")).otherwise(F.lit("N")).alias("WinRateFlag"),
        F.lit("Y").alias("SubServiceGroupAHRWithinRangeInd"),
        F.lit("N").alias("SubServiceGroupHasEffortInd"),
        F.lit("N").alias("OpportunityExtensionInd"),
        seg.alias("CompetitionCategory"),
        F.when(F.col("o_totalprice") > 450000, F.lit("Mega")).otherwise(F.lit("")).alias("MegaDealDesc"),
        F.lit("Y").alias("QuarterSpecificInd"),
        F.col("n_name").alias("CountryNm"),
        F.col("r_name").alias("ResponsibleBusinessEntityWithOverrideNm"),
        F.lit("Std").alias("StandardDealGroupDesc"),
        *[v.alias(name) for name, v in measures.items()],
        (F.col("c_custkey") % 1000).cast("double").alias(FLOAT_MEASURE),
    )


def opportunity_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry sub-segment shares: urgent/high orders split 0.75 / 0.25."""
    o = table(spark, sf_dir, "orders")
    rd = _reporting_date(F.col("o_orderdate"))
    wk = F.col("o_orderpriority") == "5-LOW"
    parts = F.array(
        F.struct(F.lit("SUB-A").alias("sub"), F.lit("0.75").cast("decimal(10,6)").alias("pct")),
        F.struct(F.lit("SUB-B").alias("sub"), F.lit("0.25").cast("decimal(10,6)").alias("pct")))
    return (o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
             .select(casts.format_wall(F.when(wk, rd).otherwise(F.last_day(rd)), "yyyyMMdd")
                      .cast("bigint").alias("Datekey"),
                     F.col("o_orderkey").alias("OpportunityId"),
                     F.concat(F.lit("SEG-"), F.col("o_orderstatus")).alias("IndustrySegment"),
                     F.concat(F.lit("GRP-"), F.substring("o_orderpriority", 1, 1)).alias("IndustryGroup"),
                     F.explode(parts).alias("p"))
             .select("Datekey", "OpportunityId", F.col("p.sub").alias("IndustrySubSegment"),
                     F.col("p.pct").alias("IndustrySubSegment_Percentage"),
                     "IndustrySegment", "IndustryGroup"))


def market_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market -> market unit mapping with flags; European units mapped twice ('Y' and 'NC')."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("r_name").alias("market"), F.col("n_name").alias("market_unit"))
    y = base.select("market", "market_unit", F.lit("Y").alias("Flag"))
    # European units are also mapped under the 'NC' flag, Asian ones under 'N'.
    nc = base.where(F.col("market") == "EUROPE").select("market", "market_unit", F.lit("NC").alias("Flag"))
    no = base.where(F.col("market") == "ASIA").select("market", "market_unit", F.lit("N").alias("Flag"))
    return y.unionByName(nc).unionByName(no)
