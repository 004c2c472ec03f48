"""Registered queries D-01..D-06 (feed pipeline operators) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.operators.asof import snapshot_asof
from wharf.operators.dedup import latest_per_key
from wharf.operators.validate import ObservedSummary
from wharf.plans import feeds
from wharf.plans.testdata import (LINEITEM_FEED, ORDERS_FEED, fixed_audit, lineitem_snapshot,
                                  orders_ods_target, orders_stage, table)
from wharf.session import scratch_path

LINEITEM_TIEBREAK = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax", "l_returnflag", "l_linestatus")
ASOF_START, ASOF_END = "1996-01-01 00:00:00", "1999-12-31 23:59:59"
SOURCE_FROM = "1999-01-01"


def d01_latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return latest_per_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"], LINEITEM_TIEBREAK)


def d02_snapshot_asof(spark: SparkSession, sf: str) -> DataFrame:
    snap = lineitem_snapshot(table(spark, sf, "lineitem"))
    lo = F.lit(ASOF_START).cast("timestamp_ntz")
    hi = F.lit(ASOF_END).cast("timestamp_ntz")
    return snapshot_asof(snap, LINEITEM_FEED.asof_keys, feeds.asof_projection(LINEITEM_FEED),
                         lo, hi, tiebreak=["FileLoadAuditId", "LineNum"])


def d02b_snapshot_asof_sql(spark: SparkSession, sf: str) -> DataFrame:
    """D-02 through the SQL table-function surface (same result, same oracle)."""
    snap = lineitem_snapshot(table(spark, sf, "lineitem"))
    name = feeds.register_asof_function(spark, "ft_LineitemFileSnapshot", snap, LINEITEM_FEED)
    return spark.sql(f"SELECT * FROM {name}(TIMESTAMP_NTZ'{ASOF_START}', TIMESTAMP_NTZ'{ASOF_END}')")


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    stage = orders_stage(table(spark, sf, "orders"))
    return feeds.validate_stage(stage, ORDERS_FEED, fixed_audit().now)


def d03_validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(spark, sf).select("ParentSystemId", "SystemId", "FileLoadAuditId", "LineNum",
                                        "InactiveInd", "InactiveDate", "InactiveReason")


def d04_validate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.stage_summary(_validated(spark, sf), ORDERS_FEED)


def d04_observed_summary(spark: SparkSession, sf: str) -> DataFrame:
    """D-04 from the aggregates that the write of the stage carries along."""
    seen = ObservedSummary(ORDERS_FEED.snapshot_from, ("ParentSystemId", "SystemId"), feeds.SYSTEMS)
    seen.watch(_validated(spark, sf)).write.parquet(scratch_path(spark, "orders-stage"))
    return seen.rows(spark)


def d05_stage_to_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    snap = feeds.snapshot_rows(_validated(spark, sf), ORDERS_FEED, fixed_audit())
    return snap.drop("InactiveDate")


def d06_upsert_ods(spark: SparkSession, sf: str) -> DataFrame:
    """Orders up to 1999 are the stored ODS, those from 1999 on are delivered anew: the
    overlap updates, the rest inserts, NULL keys insert, inactive rows stay."""
    orders = table(spark, sf, "orders")
    audit = fixed_audit()
    target = orders_ods_target(orders)
    fresh = orders.where(F.col("o_orderdate") >= F.lit(SOURCE_FROM).cast("timestamp_ntz"))
    stage = feeds.validate_stage(orders_stage(fresh, price_bump=1, loadable=True), ORDERS_FEED, audit.now)
    snap = feeds.snapshot_rows(stage, ORDERS_FEED, audit)
    src = feeds.ods_source(snap, ORDERS_FEED, audit)
    return feeds.merge_ods(target, src, ORDERS_FEED, audit).drop("InactiveDate")


def d06_merge_into_files(spark: SparkSession, sf: str) -> DataFrame:
    """D-06 as a merge into a recoverable table in ranges of StartInterval: files before the
    delivery are neither read nor replaced, and the repeat of the batch changes nothing."""
    audit = fixed_audit()
    orders = table(spark, sf, "orders")
    ods = feeds.ods_table(spark, scratch_path(spark, "orders-ods"), ORDERS_FEED)
    ods.publish(orders_ods_target(orders).repartitionByRange(16, "StartInterval"))
    fresh = orders.where(F.col("o_orderdate") >= F.lit(SOURCE_FROM).cast("timestamp_ntz"))
    stage = feeds.validate_stage(orders_stage(fresh, price_bump=1, loadable=True), ORDERS_FEED, audit.now)
    source = feeds.ods_source(feeds.snapshot_rows(stage, ORDERS_FEED, audit), ORDERS_FEED, audit)
    for _ in range(2):
        feeds.merge_ods_table(ods, source, ORDERS_FEED, audit, ("orders", 1))
    return ods.read().drop("InactiveDate")


# --------------------------------------------------------------------------- DuckDB oracles

_LI_ORDER = ", ".join(f"{c} DESC NULLS LAST" for c in ("l_shipdate", *LINEITEM_TIEBREAK))

D01_SQL = f"""
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI_ORDER}) = 1
"""

D02_SQL = f"""
WITH snap AS (
  SELECT CAST(CASE WHEN l_linestatus = 'O' THEN 3462 ELSE 3463 END AS BIGINT) AS ParentSystemId,
         CAST(CASE WHEN l_linestatus = 'O' THEN 3464 ELSE 3465 END AS BIGINT) AS SystemId,
         l_returnflag AS Cosa, l_linestatus AS Company,
         CAST(l_orderkey AS VARCHAR) AS Agent, CAST(l_linenumber AS VARCHAR) AS RoutingProfile,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS StartInterval,
         strftime(l_shipdate + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS EndInterval,
         CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS Quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS ExtendedPrice,
         CAST(l_suppkey AS VARCHAR) || '.5' AS SuppCount,
         l_shipdate AS SnapshotRowDateTime,
         l_suppkey AS FileLoadAuditId, l_partkey AS LineNum,
         l_shipdate + to_minutes(CAST(l_partkey % 97 AS BIGINT)) AS FileEffectiveDate,
         l_shipdate + to_seconds(CAST(l_suppkey AS BIGINT)) AS CreateDate,
         l_discount >= 0.1 AS InactiveInd
  FROM lineitem),
latest AS (
  SELECT * FROM snap
  WHERE NOT InactiveInd
    AND SnapshotRowDateTime >= TIMESTAMP '{ASOF_START}' AND SnapshotRowDateTime <= TIMESTAMP '{ASOF_END}'
  QUALIFY row_number() OVER (
    PARTITION BY ParentSystemId, StartInterval, EndInterval, Cosa, Company, Agent, RoutingProfile
    ORDER BY FileEffectiveDate DESC, CreateDate DESC, FileLoadAuditId DESC, LineNum DESC) = 1)
SELECT ParentSystemId, SystemId, Cosa, Company, Agent, RoutingProfile,
       strptime(substr(StartInterval, 1, 19), '%Y-%m-%dT%H:%M:%S') AS StartInterval,
       strptime(substr(EndInterval, 1, 19), '%Y-%m-%dT%H:%M:%S') AS EndInterval,
       CAST(Quantity AS DECIMAL(38,9)) AS Quantity,
       CAST(ExtendedPrice AS DECIMAL(38,9)) AS ExtendedPrice,
       CAST(CAST(SuppCount AS DECIMAL(38,9)) AS BIGINT) AS SuppCount,
       make_timestamp(epoch_us(CAST(StartInterval AS TIMESTAMPTZ))) AS UtcStartInterval,
       make_timestamp(epoch_us(CAST(EndInterval AS TIMESTAMPTZ))) AS UtcEndInterval,
       FileEffectiveDate, FileLoadAuditId, InactiveInd
FROM latest
"""


def orders_stage_sql(where: str = "TRUE", bump: int = 0, loadable: bool = False) -> str:
    def bad(text: str) -> str:
        return "NULL" if loadable else text
    price = f"CAST(CAST(o_totalprice AS DECIMAL(18,2)) + {bump} AS VARCHAR)"
    online = "CAST(CAST(floor(o_totalprice / 250) AS BIGINT) AS VARCHAR)"
    return f"""
  SELECT CAST(CASE WHEN o_orderstatus IN ('F','O') THEN 3462 ELSE 3463 END AS BIGINT) AS ParentSystemId,
         CAST(CASE WHEN o_orderstatus IN ('F','O') THEN 3464 ELSE 3465 END AS BIGINT) AS SystemId,
         o_orderstatus AS Cosa, o_orderpriority AS Company,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS Agent,
         'RP-' || substr(o_orderpriority, 1, 1) AS RoutingProfile,
         CASE WHEN o_orderkey % 61 = 0 THEN {bad("'not-a-date'")}
              ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS StartInterval,
         strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS EndInterval,
         CASE WHEN o_orderkey % 47 = 0 THEN {bad(price + " || '%'")} ELSE {price} END AS AgentIdleTime,
         CASE WHEN o_orderkey % 7 = 0 THEN {online} || '.5' ELSE {online} END AS OnlineTime,
         CASE WHEN o_orderkey % 59 = 0 THEN {bad("'x' || CAST(o_custkey % 100 AS VARCHAR)")}
              ELSE CAST(o_custkey % 100 AS VARCHAR) END AS ContactsHandled,
         CAST(year(o_orderdate) - 1994 AS BIGINT) AS FileLoadAuditId,
         o_orderkey AS LineNum, o_orderdate AS FileEffectiveDate,
         'loader' AS LoadBy, o_orderdate + INTERVAL 1 DAY AS LoadDate, 'testdata' AS LoadProcess
  FROM orders WHERE {where}"""


_NUM = "TRY_CAST({c} AS DECIMAL(38,9))"
_INT = "TRY_CAST(ROUND(TRY_CAST({c} AS DECIMAL(38,9)), 0) AS BIGINT)"
ORDERS_ERRORS_SQL = f"""concat_ws(', ',
    CASE WHEN Cosa IS NULL THEN 'Cosa missing value' END,
    CASE WHEN Agent IS NULL THEN 'Agent missing value' END,
    CASE WHEN RoutingProfile IS NULL THEN 'RoutingProfile missing value' END,
    CASE WHEN StartInterval IS NULL THEN 'StartInterval missing value'
         WHEN TRY_CAST(StartInterval AS TIMESTAMPTZ) IS NULL THEN 'StartInterval parse error' END,
    CASE WHEN EndInterval IS NULL THEN 'EndInterval missing value'
         WHEN TRY_CAST(EndInterval AS TIMESTAMPTZ) IS NULL THEN 'EndInterval parse error' END,
    CASE WHEN AgentIdleTime IS NOT NULL AND {_NUM.format(c='AgentIdleTime')} IS NULL
         THEN 'AgentIdleTime parse error' END,
    CASE WHEN OnlineTime IS NOT NULL AND {_NUM.format(c='OnlineTime')} IS NULL THEN 'OnlineTime parse error'
         WHEN {_INT.format(c='OnlineTime')} > 1800 THEN 'OnlineTime Invalid Interval Data' END,
    CASE WHEN ContactsHandled IS NOT NULL AND {_INT.format(c='ContactsHandled')} IS NULL
         THEN 'ContactsHandled parse error' END)"""


def validated_sql(where: str = "TRUE", bump: int = 0, loadable: bool = False) -> str:
    return f"""
  SELECT s.*, length(e.errs) > 0 AS InactiveInd,
         CASE WHEN length(e.errs) > 0 THEN TIMESTAMP '2024-06-30 00:00:00' END AS InactiveDate,
         CASE WHEN length(e.errs) > 0 THEN 'Validation failure: ' || e.errs END AS InactiveReason
  FROM ({orders_stage_sql(where, bump, loadable)}) s,
       LATERAL (SELECT {ORDERS_ERRORS_SQL} AS errs) e"""


D03_SQL = f"""
SELECT ParentSystemId, SystemId, FileLoadAuditId, LineNum, InactiveInd, InactiveDate, InactiveReason
FROM ({validated_sql()}) v
"""

D04_SQL = f"""
SELECT ParentSystemId, SystemId,
       min(CASE WHEN NOT InactiveInd THEN TRY_STRPTIME(substr(StartInterval, 1, 19), '%Y-%m-%dT%H:%M:%S') END) AS min_date,
       max(CASE WHEN NOT InactiveInd THEN TRY_STRPTIME(substr(StartInterval, 1, 19), '%Y-%m-%dT%H:%M:%S') END) AS max_date,
       count(*) FILTER (WHERE InactiveInd) AS rejected
FROM ({validated_sql()}) v
GROUP BY ParentSystemId, SystemId
"""

_BUSINESS = "Cosa, Company, Agent, RoutingProfile, StartInterval, EndInterval, AgentIdleTime, OnlineTime, ContactsHandled"


def snapshot_sql(where: str = "TRUE", bump: int = 0, loadable: bool = False) -> str:
    return f"""
  SELECT ParentSystemId, SystemId, {_BUSINESS},
         TRY_STRPTIME(substr(StartInterval, 1, 19), '%Y-%m-%dT%H:%M:%S') AS SnapshotRowDateTime,
         LoadBy, LoadDate, LoadProcess,
         'wharf' AS CreateBy, TIMESTAMP '2024-06-30 00:00:00' AS CreateDate, 'wharf.testdata' AS CreateProcess,
         'wharf' AS UpdateBy, TIMESTAMP '2024-06-30 00:00:00' AS UpdateDate, 'wharf.testdata' AS UpdateProcess,
         FileLoadAuditId, LineNum, FileEffectiveDate, FALSE AS InactiveInd, '' AS InactiveReason
  FROM ({validated_sql(where, bump, loadable)}) v"""


D05_SQL = f"SELECT * FROM ({snapshot_sql()}) s"

_KEYS = ("ParentSystemId", "SystemId", "Cosa", "Company", "Agent", "RoutingProfile",
         "StartInterval", "EndInterval")
_ON = " AND ".join(f"t.{k} = s.{k}" for k in _KEYS)
_ODS_COLS = ("ParentSystemId", "SystemId", "Cosa", "Company", "Agent", "RoutingProfile",
             "StartInterval", "EndInterval", "AgentIdleTime", "OnlineTime", "ContactsHandled",
             "LoadBy", "LoadDate", "LoadProcess", "CreateBy", "CreateDate", "CreateProcess",
             "UpdateBy", "UpdateDate", "UpdateProcess", "InactiveInd", "InactiveReason")
_UPDATED = ", ".join(f"t.{c}" if c.startswith("Inactive") else f"s.{c}" for c in _ODS_COLS)
_CLEAN = ", ".join(_ODS_COLS)

D06_SQL = f"""
WITH target AS (
  SELECT CAST(CASE WHEN o_orderstatus IN ('F','O') THEN 3462 ELSE 3463 END AS BIGINT) AS ParentSystemId,
         CAST(CASE WHEN o_orderstatus IN ('F','O') THEN 3464 ELSE 3465 END AS BIGINT) AS SystemId,
         o_orderstatus AS Cosa, o_orderpriority AS Company,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS Agent,
         'RP-' || substr(o_orderpriority, 1, 1) AS RoutingProfile,
         o_orderdate AS StartInterval, o_orderdate + INTERVAL 1 DAY AS EndInterval,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,9)) AS AgentIdleTime,
         CAST(floor(o_totalprice / 250) AS DECIMAL(38,9)) AS OnlineTime,
         CAST(o_custkey % 100 AS BIGINT) AS ContactsHandled,
         'legacy' AS LoadBy, o_orderdate AS LoadDate, 'legacy' AS LoadProcess,
         'legacy' AS CreateBy, o_orderdate AS CreateDate, 'legacy' AS CreateProcess,
         'legacy' AS UpdateBy, o_orderdate AS UpdateDate, 'legacy' AS UpdateProcess,
         (o_orderstatus = 'P' AND year(o_orderdate) = 1999) AS InactiveInd,
         CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) = 1999 THEN 'closed' ELSE '' END AS InactiveReason
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
snap AS ({snapshot_sql("o_orderdate >= TIMESTAMP '" + SOURCE_FROM + "'", 1, True)}),
latest AS (
  SELECT * FROM snap WHERE InactiveInd = FALSE
  QUALIFY row_number() OVER (
    PARTITION BY ParentSystemId, SystemId, Cosa, Company, Agent, RoutingProfile, StartInterval, EndInterval
    ORDER BY LoadDate DESC NULLS LAST, CreateDate DESC NULLS LAST, FileEffectiveDate DESC NULLS LAST,
             FileLoadAuditId DESC NULLS LAST,
             LineNum DESC NULLS LAST) = 1),
src AS (
  SELECT ParentSystemId, SystemId, Cosa, Company, Agent, RoutingProfile,
         strptime(substr(StartInterval, 1, 19), '%Y-%m-%dT%H:%M:%S') AS StartInterval,
         strptime(substr(EndInterval, 1, 19), '%Y-%m-%dT%H:%M:%S') AS EndInterval,
         CAST(AgentIdleTime AS DECIMAL(38,9)) AS AgentIdleTime,
         CAST(OnlineTime AS DECIMAL(38,9)) AS OnlineTime,
         CAST(ROUND(CAST(ContactsHandled AS DECIMAL(38,9)), 0) AS BIGINT) AS ContactsHandled,
         'wharf' AS LoadBy, TIMESTAMP '2024-06-30 00:00:00' AS LoadDate, 'wharf.testdata' AS LoadProcess,
         'wharf' AS CreateBy, TIMESTAMP '2024-06-30 00:00:00' AS CreateDate, 'wharf.testdata' AS CreateProcess,
         'wharf' AS UpdateBy, TIMESTAMP '2024-06-30 00:00:00' AS UpdateDate, 'wharf.testdata' AS UpdateProcess,
         FALSE AS InactiveInd, '' AS InactiveReason
  FROM latest),
act AS (SELECT * FROM target WHERE InactiveInd = FALSE)
SELECT {_UPDATED} FROM act t JOIN src s ON {_ON}
UNION ALL
SELECT {_CLEAN} FROM act t WHERE NOT EXISTS (SELECT 1 FROM src s WHERE {_ON})
UNION ALL
SELECT {_CLEAN} FROM src s WHERE NOT EXISTS (SELECT 1 FROM act t WHERE {_ON})
UNION ALL
SELECT {_CLEAN} FROM target WHERE InactiveInd IS NOT FALSE
"""

QUERIES = {
    "D-01_latest_per_key": d01_latest_per_key,
    "D-02_snapshot_asof": d02_snapshot_asof,
    "D-02b_snapshot_asof_sql": d02b_snapshot_asof_sql,
    "D-03_validate_rows": d03_validate_rows,
    "D-04_validate_summary": d04_validate_summary,
    "D-04_observed_summary": d04_observed_summary,
    "D-05_stage_to_snapshot": d05_stage_to_snapshot,
    "D-06_upsert_ods": d06_upsert_ods,
    "D-06_merge_into_files": d06_merge_into_files,
}
ORACLES = {
    "D-01_latest_per_key": D01_SQL,
    "D-02_snapshot_asof": D02_SQL,
    "D-02b_snapshot_asof_sql": D02_SQL,
    "D-03_validate_rows": D03_SQL,
    "D-04_validate_summary": D04_SQL,
    "D-04_observed_summary": D04_SQL,
    "D-05_stage_to_snapshot": D05_SQL,
    "D-06_upsert_ods": D06_SQL,
    "D-06_merge_into_files": D06_SQL,
}
