"""Opportunity mart (M-01): anchor snapshots, allocation by industry
sub-segment share, market-mapping join, 34-key aggregation, period labels.

Plan: the anchor filter (<= 24 datekeys, broadcast left-semi) and the other
row filters run first, on the snapshot scan; then the share and mapping LEFT
joins (strategy from AQE), then one hash aggregation. Labels are computed from
the grouping keys after the aggregation (A-07: the grouping is on the raw
values, so '' and NULL stay two rows that both read 'blank').
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharf.functions import casts
from wharf.functions.periods import fiscal_slot_label, quarter_slot
from wharf.operators.allocate import allocate, map_join
from wharf.operators.anchors import AnchorSpec, anchor_dates, per_datekey, select_anchors
from wharf.operators.flags import scalar

# The first-match industry-group patterns (order matters).
INDUSTRY_GROUPS = (
    ("%CMT%", "Communications, Media & Technology"),
    ("%PRD%", "Products"),
    ("%FS%", "Financial Services"),
    ("%RES%", "Resources"),
    ("%H&PS%", "Health & Public Service"),
)
# Type-of-work codes.
TYPE_OF_WORK = {"C": "Consulting", "O": "Outsourcing"}
# Fixed values: (source measure, output name), NUMERIC sums, in output order.
MEASURES = (
    ("TotalCurrentRevenueGlobalAmt", "TCR"),
    ("ContractControllableIncomeGlobalAmt", "CCI"),
    ("WorkHours", "WorkHours"),
    ("WeightedPipelineGlobalAmt", "WtdPipeline"),
    ("ServicesRevenueGlobalExcludingBEAmt", "ServicesRevenueGlobalExcludingBEAmt"),
    ("TotalCurrentRevenueGlobalExcludingBEAmt", "TCRGlobalExcludingBEAmt"),
    ("WeightedTargetMarginNumeratorGlobalExcludingBEAmt", "WeightedTargetMarginNumGlobalExcludingBEAmt"),
    ("WeightedTargetMarginDenominatorGlobalExcludingBEAmt", "WeightedTargetMarginDenGlobalExcludingBEAmt"),
    ("ServicesCostConstantAmt", "ServicesCostConstantAmt"),
    ("ServicesRevenueConstantExcludingBEAmt", "ServicesRevenueConstantExcludingBEAmt"),
    ("TotalCurrentRevenueConstantAmt", "TotalCurrentRevenueConstantAmt"),
    ("OtherBillableCostConstantAmt", "OtherBillableCostConstantAmt"),
    ("OtherBillableCostGlobalAmt", "OtherBillableCostGlobalAmt"),
    ("ServicesCostGlobalAmt", "ServicesCostGlobalAmt"),
    ("WeightedTargetMarginNumeratorConstantExcludingBEAmt", "WeightedTargetMarginNumeratorConstantExcludingBEAmt"),
    ("WeightedTargetMarginDenominatorConstantExcludingBEAmt", "WeightedTargetMarginDenominatorConstantExcludingBEAmt"),
    ("TotalCurrentRevenueConstantExcludingBEAmt", "TotalCurrentRevenueConstantExcludingBEAmt"),
    ("ContractControllableIncomeConstantAmt", "ContractControllableIncomeConstantAmt"),
)
FLOAT_MEASURE = "PursuitsGlobalAmt"
# The 34 grouping columns of the mart (raw snapshot values).
GROUP_KEYS = (
    "MasterCustomerNm", "MasterCustomerNbr", "Datekey", "MarketNm", "MarketUnitNm",
    "ClientGroupNm", "MasterCustomerIndustryNm", "ExpectedContractSignDtFiscalQuarter",
    "ExpectedContractSignDtMonth", "QuarterClosed", "MonthClosed", "StatusDesc", "StageDesc",
    "ServiceGroupDesc", "DealSizeStandardDesc", "ServicesDesc", "DealFamilyDesc", "TypeOfWorkCd",
    "WinRateFlag", "SubServiceGroupAHRWithinRangeInd", "SubServiceGroupHasEffortInd",
    "ReportingDate", "HistoricalMasterClientClassDesc", "CurrentMasterClientClassDesc",
    "OpportunityExtensionInd", "CompetitionCategory", "MegaDealDesc", "ISS_IndustryGroup",
    "ISS_IndustrySegment", "QuarterSpecificInd", "CountryNm",
    "ResponsibleBusinessEntityWithOverrideNm", "StandardDealGroupDesc", "ClientGroupCd",
)


def datekey_summary(snapshot: DataFrame, anchors: AnchorSpec = AnchorSpec()) -> DataFrame:
    """One materialized row per snapshot date feeding the X-01 slot and X-02 anchors."""
    extra = {"has_pipeline_me": F.max((F.col("StatusDesc").isin("Pipeline")
                                       & (F.col(anchors.period_col) == anchors.month_end)).cast("int")),
             "max_reporting_date": F.max("ReportingDate")}
    return per_datekey(snapshot, anchors, extra)


def anchor_slot(snapshot: DataFrame, keys: DataFrame | None = None, key: str = "Datekey"):
    """X-01 slot of the month of max(ReportingDate) at the newest Pipeline 'ME' snapshot."""
    keys = datekey_summary(snapshot) if keys is None else keys
    newest = F.max(F.when(F.col("has_pipeline_me") == 1,
                          F.struct(F.col(key), F.col("max_reporting_date").alias("rd"))))["rd"]
    return quarter_slot(F.month(scalar(keys, newest)))


def reporting_status_date(status, expected_month, month_closed):
    """X-10 first of month of the expected sign month (Unqualified/Pipeline) else of MonthClosed."""
    open_ = (status == "Unqualified") | (status == "Pipeline")
    return F.when(open_, casts.month_name_first_day(expected_month)) \
            .otherwise(casts.month_name_first_day(month_closed))


def opportunity_mart(snapshot: DataFrame, shares: DataFrame, mapping: DataFrame,
                     anchors: AnchorSpec = AnchorSpec(), dedupe_mapping: bool = False) -> DataFrame:
    """M-01 the opportunity backup table, one lazy plan."""
    keys = datekey_summary(snapshot, anchors)
    slot = anchor_slot(snapshot, keys, anchors.key)
    facts = snapshot.where((F.col("ExpectedContractSignDtMonth") != "")
                           & (F.col("StatusDesc") != "Closed-Duplicated")
                           & (F.col("PeriodCd") == "ME"))
    facts = select_anchors(facts, anchor_dates(snapshot, anchors, keys), anchors.key)
    facts = map_join(facts, mapping, [("MarketNm", "market"), ("MarketUnitNm", "market_unit")],
                     where=F.col("Flag").isin("Y", "NC"), dedupe_right=dedupe_mapping)
    agg = allocate(
        facts, shares, on=[("Datekey", "Datekey"), ("OpportunityId", "OpportunityId")],
        measures={out: F.col(src) for src, out in MEASURES},
        group_by=list(GROUP_KEYS), share_col="IndustrySubSegment_Percentage",
        labels={"ISS_IndustryGroup": "IndustryGroup", "ISS_IndustrySegment": "IndustrySegment"},
        float_measures={FLOAT_MEASURE: F.col(FLOAT_MEASURE)},
    )
    c = F.col
    ts_null = casts.typed_null("timestamp")
    return agg.select(
        "MasterCustomerNm", "MasterCustomerNbr", "HistoricalMasterClientClassDesc",
        c("CurrentMasterClientClassDesc").alias("CurrentMasterClientClass"),
        "Datekey",
        casts.blank_default(c("MarketNm")).alias("Market"),
        casts.blank_default(c("MarketUnitNm")).alias("MarketUnit"),
        casts.first_match(c("ClientGroupNm"), INDUSTRY_GROUPS, default="blank").alias("IndustryGroup"),
        casts.blank_default(c("MasterCustomerIndustryNm")).alias("IndustrySegment"),
        ts_null.alias("ExpectedContractSignDt"),
        "ExpectedContractSignDtFiscalQuarter", "QuarterClosed", "MonthClosed", "StatusDesc",
        "StageDesc",
        ts_null.alias("PipelineEntryDt"), ts_null.alias("StatusSinceDt"),
        ts_null.alias("ConsultingStartDt"), ts_null.alias("ConsultingEndDt"),
        "TCR",
        casts.blank_default(c("ServiceGroupDesc")).alias("ServiceGroup"),
        "CCI", "WorkHours", "WtdPipeline", "ServicesRevenueGlobalExcludingBEAmt",
        "DealSizeStandardDesc", "TCRGlobalExcludingBEAmt",
        "WeightedTargetMarginNumGlobalExcludingBEAmt", "WeightedTargetMarginDenGlobalExcludingBEAmt",
        "ServicesDesc", "DealFamilyDesc",
        casts.code_map(c("TypeOfWorkCd"), TYPE_OF_WORK).alias("TypeOfWorkCd"),
        "WinRateFlag", "SubServiceGroupAHRWithinRangeInd", "SubServiceGroupHasEffortInd",
        *[out for _, out in MEASURES[8:]],
        fiscal_slot_label(c("ReportingDate"), slot).alias("Quarter_Beginning_Period"),
        reporting_status_date(c("StatusDesc"), c("ExpectedContractSignDtMonth"),
                              c("MonthClosed")).alias("ReportingStatusDate"),
        c("ReportingDate").cast("date").alias("ReportingDate"),
        FLOAT_MEASURE, "OpportunityExtensionInd", "CompetitionCategory", "MegaDealDesc",
        "ClientGroupNm", "ISS_IndustryGroup", "ISS_IndustrySegment", "QuarterSpecificInd",
        c("CountryNm").alias("Country"),
        c("ResponsibleBusinessEntityWithOverrideNm").alias("service_dim"),
        "StandardDealGroupDesc",
        casts.blank_default(c("ClientGroupCd")).alias("ClientGroupCd"),
    )
