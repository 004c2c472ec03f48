"""Merge guard, partition and folder safety, strict parsers, wide amounts, intake headers."""
import datetime as dt
import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from test_feeds import audit, empty_target, stage
from test_sources_streaming import write_csv
from wharf.functions import casts
from wharf.operators.allocate import allocate
from wharf.plans import feeds, queries_feed
from wharf.plans.feeds import FEEDS
from wharf.sources import layers
from wharf.sources.stage import read_stage
from wharf.sources.versions import VersionedTable
from wharf.streaming.intake import incremental_intake


def _queue_source(spark, values):
    spec = FEEDS["AgentQueueDaily"]
    rows = [(i + 1, 1, {"Queue": q}) for i, q in enumerate(values)]
    return spec, feeds.ods_source(feeds.snapshot_rows(stage(spark, spec, rows), spec, audit()), spec, audit())


def test_colliding_normalised_keys_fail_the_second_merge(spark, tmp_dir):
    spec, source = _queue_source(spark, ["Q1", "\t Q1 \n"])   # two raw keys, one merge key
    first = feeds.merge_ods(empty_target(spark, spec), source, spec, audit())
    layers.rebuild_table(first, f"{tmp_dir}/ods")               # no target row is met: both insert
    assert spark.read.parquet(f"{tmp_dir}/ods").count() == 2
    with pytest.raises(PySparkException, match="several source rows"):
        feeds.merge_ods(spark.read.parquet(f"{tmp_dir}/ods"), source, spec, audit()).collect()


def test_three_identical_runs_do_not_grow(spark, tmp_dir):
    spec, source = _queue_source(spark, ["Q1", "Q2", "Q3"])
    target = empty_target(spark, spec)
    for _ in range(3):
        layers.rebuild_table(feeds.merge_ods(target, source, spec, audit()), f"{tmp_dir}/ods")
        target = spark.read.parquet(f"{tmp_dir}/ods")
        assert target.count() == 3


def test_merge_reads_each_side_once(spark):
    plan = queries_feed.d06_upsert_ods(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2                        # target and source, one scan each
    assert plan.count("Window [row_number()") == 1


def test_partition_without_month_keeps_its_rows(spark, tmp_dir):
    spec, _ = _queue_source(spark, ["x"])
    rows = [(1, 1, {"Queue": "kept", "StartInterval": None}), (2, 1, {"Queue": "b"})]
    src = feeds.ods_source(feeds.snapshot_rows(stage(spark, spec, rows), spec, audit()), spec, audit())
    first = feeds.with_ods_partition(feeds.merge_ods(empty_target(spark, spec), src, spec, audit()), spec)
    first.write.partitionBy(*feeds.ods_partitions(spec)).parquet(f"{tmp_dir}/ods")
    rows = [(3, 2, {"Queue": "new", "StartInterval": None})]
    more = feeds.ods_source(feeds.snapshot_rows(stage(spark, spec, rows), spec, audit()), spec, audit())
    feeds.merge_ods_partitions(spark, f"{tmp_dir}/ods", more, spec, audit())
    assert {r.Queue for r in spark.read.parquet(f"{tmp_dir}/ods").collect()} == {"kept", "b", "new"}


class _Files:
    """A file system of names; renames to ``refused`` return false."""

    def __init__(self, names, refused=()):
        self.names, self.refused = set(names), set(refused)

    def exists(self, p):
        return p in self.names

    def rename(self, a, b):
        if b in self.refused and a == "fresh":
            return False
        self.names.remove(a)
        self.names.add(b)
        return True

    def delete(self, p, _):
        self.names.remove(p)


def test_failed_rename_keeps_the_old_table():
    fs = _Files({"fresh", "table"}, refused={"table"})
    with pytest.raises(OSError):
        layers._swap(fs, "fresh", "table", "aside")
    assert fs.names == {"fresh", "table"}
    fs = _Files({"fresh", "table"})
    layers._swap(fs, "fresh", "table", "aside")
    assert fs.names == {"table"}


def test_crash_between_moves_leaves_the_old_table_whole():
    class Crash(_Files):
        def rename(self, a, b):
            if a == "fresh":
                raise KeyboardInterrupt
            return super().rename(a, b)
    fs = Crash({"fresh", "table"})
    with pytest.raises(KeyboardInterrupt):
        layers._swap(fs, "fresh", "table", "aside")
    assert "aside" in fs.names and "fresh" in fs.names


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parsers_take_whole_dates_only(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        bad = ["12:30", "T08:30:00", "2024", "2024-06", "", "x"]
        df = spark.createDataFrame([(b,) for b in bad], "s string")
        assert all(r[0] is None for r in df.select(casts.utc_datetime("s")).collect())
        good = spark.createDataFrame([("2024-06-01",), ("2024-06-01T08:00:00-05:00",), ("2024-06-01 13:00:00",)], "s string")
        got = [r[0] for r in good.select(casts.utc_datetime("s")).collect()]
        assert got == [dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 1, 13), dt.datetime(2024, 6, 1, 13)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wall = spark.createDataFrame([("2024-01-01 08:00:00",), ("2024-1-1T08:00:00.00",), ("2024-01-01T08:00:00Z",)], "s string")
    assert [r[0] for r in wall.select(casts.wall_datetime("s")).collect()] == [None, None, dt.datetime(2024, 1, 1, 8)]


def test_strict_date_time_raises_on_a_time_of_day(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("12:30",)], "s string").select(casts.utc_datetime("s", safe=False)).collect()


def test_all_white_space_is_trimmed(spark):
    df = spark.createDataFrame([("\t a \n",), (" \r\n",), (None,), (" b",)], "s string")
    assert [r[0] for r in df.select(casts.normalize_blank_to_empty("s")).collect()] == ["a", "", "", "b"]


@pytest.mark.parametrize("preaggregate", [True, False])
def test_wide_amounts_allocate_exactly(spark, preaggregate):
    from decimal import Decimal as D
    facts = spark.createDataFrame([("k", D("1000000000000000000.01")), ("k", D("-7.55"))], "k string, m decimal(28,2)")
    shares = spark.createDataFrame([("k", D("0.25"))], "k string, s decimal(5,2)")
    out = allocate(facts, shares, [("k", "k")], {"m": F.col("m")}, ["k"], "s", preaggregate=preaggregate).collect()
    assert out[0].m == D("249999999999999998.115")


def test_swapped_header_is_an_error_and_masks_are_a_list(spark, tmp_dir):
    write_csv(f"{tmp_dir}/a/one.csv", ["x", "y"], [["1", "2"]])
    write_csv(f"{tmp_dir}/a/two.txt", ["x", "y"], [["3", "4"]])
    write_csv(f"{tmp_dir}/a/three.bin", ["x", "y"], [["5", "6"]])
    kw = dict(parent_id=1, system_id=2, audit_id=3)
    df = read_stage(spark, f"{tmp_dir}/a", ["x", "y"], mask=["*.csv", "*.txt"], **kw)
    assert sorted(r.x for r in df.collect()) == ["1", "3"]
    write_csv(f"{tmp_dir}/b/one.csv", ["y", "x"], [["2", "1"]])
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not conform"):
        read_stage(spark, f"{tmp_dir}/b", ["x", "y"], **kw).collect()


def test_newer_file_of_one_trigger_wins(spark, tmp_dir):
    spec = FEEDS["LoginDaily"]
    row = ["c", "co", "a", "f", "l", "rp", "x", '"Jun 1, 2024 5:00:00 PM"']
    old, new = f"{tmp_dir}/in/z_old.csv", f"{tmp_dir}/in/a_new.csv"
    names = list(spec.columns)
    other = row[:3] + ["filler", "l", "rp2", "x", row[7]]
    write_csv(old, names, [other + ["9"], other + ["8"], row[:3] + ["older", "l", "rp", "x", row[7], "60"]])
    write_csv(new, names, [row[:3] + ["newer", "l", "rp", "x", row[7], "60"]])
    os.utime(old, (time.time() - 90000,) * 2)
    q = incremental_intake(spark, f"{tmp_dir}/in", spec, parent_id=3462, system_id=3464, snapshot_path=f"{tmp_dir}/snap",
                           ods_path=f"{tmp_dir}/ods", checkpoint=f"{tmp_dir}/ck")
    q.awaitTermination(120)
    assert q.exception() is None
    got = [r for r in VersionedTable(spark, f"{tmp_dir}/ods").read().collect() if r.RoutingProfile == "rp"]
    assert [r.FirstName for r in got] == ["newer"]
    audits = spark.read.parquet(f"{tmp_dir}/snap").select("FileLoadAuditId").distinct().count()
    assert audits == 2


def test_folders_go_to_their_feeds(spark):
    from wharf.sources.stage import route_to_feed
    df = spark.createDataFrame([("Agent - Daily",), ("Login",), (None,)], "folder string")
    rules = {"Agent - Daily": "AgentDaily", "Login": "LoginDaily"}
    got = [r[0] for r in df.select(route_to_feed(rules, F.col("folder"), "Other")).collect()]
    assert got == ["AgentDaily", "LoginDaily", "Other"]
    with pytest.raises(PySparkException):
        df.select(route_to_feed(rules, F.col("folder"))).collect()


def test_run_audit_starts_and_finishes(spark):
    from wharf.sources.layers import run_finished, run_started
    started = run_started(spark, 7, "daily", [(3462, 3464), (3463, 3465)])
    assert all(r.LastCompletedDate is None for r in started.collect())
    summary = spark.createDataFrame([(3462, 3464, 3)], "ParentSystemId bigint, SystemId bigint, rejected bigint")
    rows = {r.SystemId: r for r in run_finished(started, summary).collect()}
    assert rows[3464].InactiveReason == "3 rows rejected" and rows[3465].InactiveReason == ""
    assert all(r.LastCompletedDate is not None for r in rows.values())
    failed = run_finished(started, failure="load failed").collect()
    assert all(r.LastCompletedDate is None and r.InactiveReason == "load failed" for r in failed)


def test_freshness_reads_a_table_once(spark):
    from wharf.operators.reshape import data_as_of
    df = spark.range(5).selectExpr("20240801 + id AS k", "date'2024-09-01' AS d")
    probes = {"a": (df, F.col("k"), "datekey"), "b": (df, F.col("d"), "date")}
    out = data_as_of(probes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    assert {r.View_name: r.datekey for r in out.collect()} == {"a": "20240805", "b": "20240901"}
