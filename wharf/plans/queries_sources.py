"""Registered queries for intake and layers (S-01..S-09, K-01): the given tables are
delivered as CSV sheets in the shared folder, loaded, published and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.operators.validate import summarize
from wharf.plans import feeds
from wharf.plans.feeds import FEEDS
from wharf.plans.testdata import fixed_audit, table
from wharf.session import scratch_path
from wharf.sources import layers, stage
from wharf.sources.ledger import FileLedger
from wharf.sources.versions import VersionedTable
from wharf.streaming.intake import incremental_intake, unique_rows

#: Files of one delivered sheet.
SHEET_FILES = 4
SHEET = ("OrderKey", "LineNumber", "Quantity", "Flag")
LOGIN = FEEDS["LoginDaily"]


def deliver(rows: DataFrame, folder: str, key: str, files: int = SHEET_FILES) -> None:
    """Put a sheet into a landing folder as part-<n>.csv, in place of an earlier delivery."""
    spark = rows.sparkSession
    fresh = scratch_path(spark, "sheet")
    rows.repartition(files, key).write.option("header", True).csv(fresh)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(fresh)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            to = jvm.org.apache.hadoop.fs.Path(target, f"part-{int(name.split('-')[1])}.csv")
            fs.delete(to, False)
            if not fs.rename(status.getPath(), to):
                raise OSError(f"could not deliver {to}")


def _sheet(lineitem: DataFrame) -> DataFrame:
    """Line items as a sheet: all text, as a CSV export writes them."""
    return lineitem.select(F.col("l_orderkey").alias("OrderKey"), F.col("l_linenumber").alias("LineNumber"),
                           F.col("l_quantity").cast("decimal(18,2)").alias("Quantity"),
                           F.col("l_returnflag").alias("Flag"))


def s01_file_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over two folders: both new; one grown by its later lines; nothing new.

    Ledger rows per run, folder and status.
    """
    lines = table(spark, sf, "lineitem")
    landing = scratch_path(spark, "landing")
    ledger = FileLedger(spark, scratch_path(spark, "ledger"))
    early = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    first, second = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    for run, sheets in enumerate([{"3462": first & early, "3463": second}, {"3462": first}, {}], 1):
        for folder, rows in sheets.items():
            deliver(_sheet(lines.where(rows)), f"{landing}/{folder}", "OrderKey")
        taken = ledger.take(landing, ["*.csv", "*.txt"])
        names = ledger.to_load(taken)
        counts = spark.createDataFrame([], "file string, n_rows bigint")
        if names:
            sheets_read = spark.read.schema(stage.string_schema(SHEET)).option("header", True).csv(names)
            counts = sheets_read.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
        for _ in range(2):                                     # a repeated run adds nothing
            ledger.record(taken, counts, run)
    folder = F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)
    return ledger.entries().groupBy("run_id", folder.alias("folder"), "status").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"))


S01_SQL = f"""
SELECT CAST(run_id AS BIGINT) AS run_id, folder, status, CAST({SHEET_FILES} AS BIGINT) AS n_files, count(*) AS n_rows
FROM (SELECT 1 AS run_id, '3462' AS folder, 'new' AS status FROM lineitem
      WHERE l_linestatus = 'F' AND l_shipdate < TIMESTAMP '1997-01-01'
      UNION ALL SELECT 1, '3463', 'new' FROM lineitem WHERE l_linestatus = 'O'
      UNION ALL SELECT 2, '3462', 'redelivered' FROM lineitem WHERE l_linestatus = 'F') d
GROUP BY run_id, folder, status
"""


def s03_stage_load(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of two folders, routed by folder, loaded as text; rows and lines per feed."""
    lines = table(spark, sf, "lineitem")
    landing = scratch_path(spark, "landing")
    for mode in ("A", "R"):
        deliver(_sheet(lines.where(F.col("l_returnflag") == mode)), f"{landing}/{mode}", "OrderKey")
    route = stage.route_to_feed({"A": "AgentDaily", "R": "QueueRoutingDaily"},
                                stage.route_by_folder("file"))
    parts = []
    for mode in ("A", "R"):
        rows = stage.read_stage(spark, f"{landing}/{mode}", SHEET, parent_id=3462, system_id=3464, audit_id=7, mask="part-*.csv")
        parts.append(rows.withColumn("file", F.lit(f"x/{mode}/part")).withColumn("Feed", route))
    both = layers.union_shards(parts)
    return both.select("Feed", "ParentSystemId", "SystemId", *SHEET, "FileLoadAuditId", "LoadProcess", "InactiveInd",
                       (F.col("LineNum") > 0).alias("numbered"))


S03_SQL = """
SELECT CASE l_returnflag WHEN 'A' THEN 'AgentDaily' ELSE 'QueueRoutingDaily' END AS Feed,
       CAST(3462 AS BIGINT) AS ParentSystemId, CAST(3464 AS BIGINT) AS SystemId,
       CAST(l_orderkey AS VARCHAR) AS OrderKey, CAST(l_linenumber AS VARCHAR) AS LineNumber,
       CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS Quantity, l_returnflag AS Flag,
       CAST(7 AS BIGINT) AS FileLoadAuditId, 'wharf.read_stage' AS LoadProcess, FALSE AS InactiveInd, TRUE AS numbered
FROM lineitem WHERE l_returnflag IN ('A', 'R')
"""


def _broken(k: Column, fields: list[Column]) -> Column:
    """The text of a line; by its key a field short, a field long, or with an open quote."""
    whole = F.concat_ws(",", *fields)
    return (F.when(k % 29 == 0, F.concat_ws(",", *fields[:-1]))
            .when(k % 31 == 0, F.concat(whole, F.lit(",extra")))
            .when(k % 37 == 0, F.concat(F.lit('"'), whole)).otherwise(whole))


def s03_malformed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text lines of which some are malformed: loaded rows, rejects with their
    text, and the V-05 count of both."""
    orders = table(spark, sf, "orders")
    fields = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    names = ("OrderKey", "CustKey", "Status")
    # One text column under the header's name, without quotes: lines are written as they are.
    sheets = scratch_path(spark, "lines")
    orders.select(_broken(F.col("o_orderkey"), fields).alias(",".join(names))).write.option("header", True).option(
        "sep", "\u0001").option("quote", "").csv(sheets)
    kw = dict(parent_id=3462, system_id=3464, audit_id=1, mask="part-*")
    loaded = stage.read_stage(spark, sheets, names, keep_malformed=False, **kw)
    rejects = stage.read_rejects(spark, sheets, names, **kw)
    counted = summarize(loaded.unionByName(rejects, allowMissingColumns=True), None, ("ParentSystemId",))
    return (loaded.select(F.concat_ws(",", *names).alias("line"), F.lit("loaded").alias("kind"))
            .unionByName(rejects.select(F.col("RawRecord").alias("line"), F.col("InactiveReason").alias("kind")))
            .unionByName(counted.select(F.col("rejected").cast("string").alias("line"), F.lit("rejected").alias("kind"))))


S03_MALFORMED_SQL = """
WITH lines AS (
  SELECT o_orderkey AS k, concat_ws(',', o_orderkey, o_custkey, o_orderstatus) AS whole,
         concat_ws(',', o_orderkey, o_custkey) AS short FROM orders),
made AS (
  SELECT CASE WHEN k % 29 = 0 THEN short WHEN k % 31 = 0 THEN whole || ',extra'
              WHEN k % 37 = 0 THEN '"' || whole ELSE whole END AS line,
         CASE WHEN k % 29 = 0 OR k % 31 = 0 OR k % 37 = 0 THEN 'Malformed row' ELSE 'loaded' END AS kind
  FROM lines)
SELECT line, kind FROM made
UNION ALL SELECT CAST(count(*) AS VARCHAR), 'rejected' FROM made WHERE kind <> 'loaded'
"""


def s06_publish_and_recover(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuild is published, a second run is lost before its pointer, a third appends:
    readers see the first and the third; deleting what nothing refers to changes no row."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kept = VersionedTable(spark, scratch_path(spark, "orders-copy"), ["o_orderkey"])
    kept.publish(orders.where("o_orderstatus = 'P'"))
    kept.publish(orders.where("o_orderstatus = 'F'"), None, ("rebuild", 1))
    kept.write(orders)                                         # written, never published
    kept.publish(orders.where("o_orderstatus = 'O'"), [], ("append", 1))
    kept.vacuum()
    return kept.read()


S06_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')"


def s07_raw_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A table copied as it is (rebuilt twice), then read by its partitions."""
    path = scratch_path(spark, "customer-copy")
    for _ in range(2):
        layers.rebuild_table(table(spark, sf, "customer"), path, partition_by=["c_mktsegment"])
    return spark.read.parquet(path).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        "c_custkey", "c_name", "c_mktsegment")


S07_SQL = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


def s08_publish_views(spark: SparkSession, sf: str) -> DataFrame:
    """A published view over a table that is rebuilt afterwards: the view shows the new rows."""
    kept = VersionedTable(spark, scratch_path(spark, "part-copy"))
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    for rows in (parts.where("p_size < 10"), parts):
        kept.publish(rows)
        kept.read().createOrReplaceTempView("wharf_part_copy")
    return spark.sql("SELECT p_brand, count(*) AS n_parts, max(p_size) AS max_size FROM wharf_part_copy GROUP BY p_brand")


S08_SQL = "SELECT p_brand, count(*) AS n_parts, max(p_size) AS max_size FROM part GROUP BY p_brand"


def s09_run_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of a run over the orders stage: opened, then completed with rejects."""
    from wharf.plans.queries_feed import d04_validate_summary
    now = fixed_audit().now
    opened = layers.run_started(spark, 5, "orders", [*feeds.SYSTEMS, (3999, 4001)], now=now)
    done = layers.run_finished(opened, d04_validate_summary(spark, sf), now=now)
    failed = layers.run_finished(layers.run_started(spark, 6, "orders", feeds.SYSTEMS[:1], now=now), failure="lost")
    return done.unionByName(failed).select("RunId", "JobName", "ParentSystemId", "SystemId",
                                           F.col("LastCompletedDate").isNotNull().alias("completed"), "InactiveReason")


def k01_login_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries of login sheets through the intake stream, the second with all of the
    first in it: the ODS holds each key once, with the newest values."""
    orders = table(spark, sf, "orders")
    values = {"Cosa": F.col("o_orderstatus"), "Company": F.col("o_orderpriority"),
              "Agent": F.col("o_custkey").cast("string"), "FirstName": F.lit("f"), "LastName": F.lit("l"),
              "RoutingProfile": F.concat(F.lit("RP"), (F.col("o_orderkey") % 3).cast("string")),
              "Login": F.lit("x"), "Logout": F.lit("Jun 1, 2024 5:00:00 PM"),
              "Duration": F.col("o_orderkey").cast("string")}
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "login-ods")
    snapshot, checkpoint = scratch_path(spark, "login-snapshot"), scratch_path(spark, "login-checkpoint")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    for folder, rows, name in (("one", orders.where(early), "old"), ("two", orders, "new")):
        sheet = rows.select(*[(F.lit(name) if c == "FirstName" else values[c]).alias(c) for c in LOGIN.columns])
        deliver(sheet, f"{landing}/{folder}", "Duration")
        incremental_intake(spark, landing, LOGIN, parent_id=3462, system_id=3464, snapshot_path=snapshot,
                           ods_path=path, checkpoint=checkpoint).awaitTermination()
    return feeds.ods_table(spark, path, LOGIN).read().select(
        "ParentSystemId", "Cosa", "Company", "Agent", "FirstName", "RoutingProfile", "Logout", "Duration", "InactiveInd")


K01_SQL = """
SELECT CAST(3462 AS BIGINT) AS ParentSystemId, o_orderstatus AS Cosa, o_orderpriority AS Company,
       CAST(o_custkey AS VARCHAR) AS Agent, 'new' AS FirstName, 'RP' || CAST(o_orderkey % 3 AS VARCHAR) AS RoutingProfile,
       '06/01/2024 05:00:00 PM' AS Logout, CAST(o_orderkey AS DECIMAL(38,9)) AS Duration, FALSE AS InactiveInd
FROM orders
"""

def k01_unique_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The events delivered twice as a stream, in files by day: each key passes once."""
    events = table(spark, sf, "events").where("ts IS NOT NULL")
    landing, out = scratch_path(spark, "events"), scratch_path(spark, "unique-events")
    for _ in range(2):
        events.select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id").write.mode("append").parquet(landing)
    schema = spark.read.parquet(landing).schema
    stream = unique_rows(spark.readStream.schema(schema).parquet(landing), ["event_id", "user_id"], "at", "400 days")
    (stream.select("event_id", "user_id").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark, "unique-checkpoint")).trigger(availableNow=True)
     .start().awaitTermination())
    return spark.read.parquet(out)


K01_UNIQUE_SQL = "SELECT DISTINCT event_id, user_id FROM events WHERE ts IS NOT NULL"

QUERIES = {
    "S-01_file_ledger": s01_file_ledger,
    "S-03_stage_load": s03_stage_load,
    "S-03_malformed_rows": s03_malformed_rows,
    "S-06_publish_and_recover": s06_publish_and_recover,
    "S-07_raw_copy": s07_raw_copy,
    "S-08_publish_views": s08_publish_views,
    "S-09_run_audit": s09_run_audit,
    "K-01_login_intake": k01_login_intake,
    "K-01_unique_rows": k01_unique_rows,
}


def _s09_sql() -> str:
    from wharf.plans.queries_feed import D04_SQL
    return f"""
SELECT CAST(5 AS BIGINT) AS RunId, 'orders' AS JobName, s.p AS ParentSystemId, s.q AS SystemId, TRUE AS completed,
       CASE WHEN coalesce(d.rejected, 0) > 0 THEN CAST(d.rejected AS VARCHAR) || ' rows rejected' ELSE '' END AS InactiveReason
FROM (VALUES (CAST(3462 AS BIGINT), CAST(3464 AS BIGINT)), (3463, 3465), (3999, 4001)) s(p, q)
LEFT JOIN ({D04_SQL}) d ON d.ParentSystemId = s.p AND d.SystemId = s.q
UNION ALL SELECT 6, 'orders', 3462, 3464, FALSE, 'lost'
"""


ORACLES = {
    "S-01_file_ledger": S01_SQL,
    "S-03_stage_load": S03_SQL,
    "S-03_malformed_rows": S03_MALFORMED_SQL,
    "S-06_publish_and_recover": S06_SQL,
    "S-07_raw_copy": S07_SQL,
    "S-08_publish_views": S08_SQL,
    "S-09_run_audit": _s09_sql(),
    "K-01_login_intake": K01_SQL,
    "K-01_unique_rows": K01_UNIQUE_SQL,
}
