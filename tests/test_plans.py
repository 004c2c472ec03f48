"""Physical-plan shape checks: what reaches the scan, what shuffles, what is broadcast."""
import contextlib
import io
import re

from pyspark.sql import functions as F

from wharf.operators.anchors import AnchorSpec, anchor_dates, select_anchors
from wharf.operators.dedup import latest_per_key
from wharf.plans import feeds, views
from wharf.plans.feeds import FEEDS
from wharf.plans.queries_views import d16_footer_maxima, d19_dim_lookup_left, dcs_input
from wharf.plans.queries_feed import d03_validate_rows
from wharf.sources.footers import footer_reader, for_maxima, partition_values

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_latest_per_key_prelimits_before_shuffle(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan(latest_per_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    partial = p.index("row_number(), 1, Partial")
    exchange = p.index("hashpartitioning(l_orderkey")
    assert partial < exchange or p.count("WindowGroupLimit") >= 2


def test_asof_pushes_partition_and_date_filters(spark, tmp_dir):
    spec = FEEDS["AgentDaily"]
    cols = {c: F.lit("1") for c in spec.columns}
    cols.update(StartInterval=F.lit("2024-06-01T08:00:00"), EndInterval=F.lit("2024-06-01T08:30:00"))
    snap = (spark.range(10).select(
        F.lit(3462).cast("bigint").alias("ParentSystemId"), F.lit(3464).cast("bigint").alias("SystemId"),
        *[v.alias(k) for k, v in cols.items()],
        F.expr("timestamp_ntz'2024-06-01 08:00:00'").alias("SnapshotRowDateTime"),
        F.col("id").alias("FileLoadAuditId"), F.col("id").alias("LineNum"),
        F.expr("timestamp_ntz'2024-06-02 00:00:00'").alias("FileEffectiveDate"),
        F.expr("timestamp_ntz'2024-06-02 00:00:00'").alias("CreateDate"),
        F.lit(False).alias("InactiveInd")))
    snap.write.partitionBy("ParentSystemId").parquet(f"{tmp_dir}/snap")
    df = feeds.feed_asof(spark.read.parquet(f"{tmp_dir}/snap"), spec, 3462,
                         F.expr("timestamp_ntz'2024-06-01 00:00:00'"), F.expr("timestamp_ntz'2024-06-30 00:00:00'"))
    p = plan(df)
    assert "PartitionFilters: [isnotnull(ParentSystemId" in p and "(ParentSystemId" in p
    pushed = [line for line in p.splitlines() if line.startswith("PushedFilters")][0]
    assert "SnapshotRowDateTime" in pushed and "InactiveInd" in pushed
    assert df.count() == 1


def test_validation_is_row_local(spark):
    p = plan(d03_validate_rows(spark, SF))
    assert "Join" not in p and "Exchange" not in p


def test_flag_views_use_scalar_subqueries_not_joins(spark):
    p = plan(views.view2_unpivot_flag(dcs_input(spark, SF)))
    assert "Subquery" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_only_the_bounded_anchor_list_is_broadcast(spark):
    facts = spark.createDataFrame([(20240831, "ME", "FY24Q4", 1)],
                                  "Datekey bigint, PeriodCd string, QuarterClosed string, v int")
    p = plan(select_anchors(facts, anchor_dates(facts, AnchorSpec())))
    assert len(re.findall(r"\(\d+\) BroadcastExchange", p)) == 1 and "LeftSemi" in p


def test_column_pruning_reaches_scan(spark):
    p = plan(d19_dim_lookup_left(spark, SF))
    schema = [line for line in p.splitlines() if line.startswith("ReadSchema") and "c_custkey" in line][0]
    assert "c_acctbal" not in schema and "c_mktsegment" not in schema


def test_stored_maxima_come_from_footers(spark, tmp_dir):
    p = plan(d16_footer_maxima(spark, SF))
    assert p.count("PushedAggregation: [MAX(") == 4 and "PushedAggregation: [COUNT(*)]" in p
    assert "FileScan" not in p and "ColumnarToRow" not in p            # no row is read

    rows = [(1, "2024-01-31", "b", "FY24Q1"), (5, None, None, "FY24Q2"), (7, "2023-01-31", "a", None)]
    made = spark.createDataFrame(rows, "n long, d string, t string, q string").withColumn("d", F.col("d").cast("date"))
    made.repartition(3).write.partitionBy("q").parquet(f"{tmp_dir}/t")
    stored = footer_reader(spark, f"{tmp_dir}/t")
    by = for_maxima(spark, f"{tmp_dir}/t", ["n", "d", "t"])
    tops = {c: by[c].agg(F.max(c)) for c in by}
    assert {c: str(top.first()[0]) for c, top in tops.items()} == {"n": "7", "d": "2024-01-31", "t": "b"}
    assert "PushedAggregation: [MAX(n)]" in plan(tops["n"])
    assert "FileScan" in plan(tops["d"]) or "Scan parquet" in plan(tops["d"])   # one file has no date at all
    assert "PushedAggregation" not in plan(tops["t"])                           # texts: an ordinary scan
    assert partition_values(stored, "q").agg(F.max("q")).first()[0] == "FY24Q2"
    made.limit(0).write.parquet(f"{tmp_dir}/none")
    assert for_maxima(spark, f"{tmp_dir}/none", ["n"])["n"].agg(F.max("n")).first()[0] is None
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")   # the caller's reads keep their reader
