import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharf.operators.upsert import Audit
from wharf.plans import feeds
from wharf.plans.feeds import FEEDS

NOW = dt.datetime(2024, 6, 30)
LINEAGE = ("ParentSystemId bigint, SystemId bigint, FileLoadAuditId bigint, LineNum bigint, "
           "FileEffectiveDate timestamp_ntz, LoadBy string, LoadDate timestamp_ntz, LoadProcess string, "
           "InactiveInd boolean, InactiveDate timestamp_ntz, InactiveReason string")


def audit():
    return Audit(now=F.lit(NOW).cast("timestamp_ntz"), user=F.lit("tester"), process="test")


def stage(spark, spec, rows):
    """rows: list of (line, load_day, {column: value}); other business columns get '1'."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in spec.columns])
    data = []
    for line, day, values in rows:
        biz = {c: "1" for c in spec.columns}
        biz.update({"Cosa": "c", "Company": "co", "Agent": "a", "RoutingProfile": "rp", "Queue": " q ",
                    "StartInterval": "2024-06-01T08:00:00-05:00", "EndInterval": "2024-06-01T08:30:00-05:00",
                    "Login": "l", "Logout": "Jun 1, 2024 5:00:00 PM", "Duration": "60"})
        biz.update(values)
        data.append(tuple(biz[c] for c in spec.columns) +
                    (3462, 3464, 1, line, dt.datetime(2024, 6, 1), "u", dt.datetime(2024, 6, day), "p",
                     False, None, None))
    lineage = spark.createDataFrame([], LINEAGE).schema
    return spark.createDataFrame(data, T.StructType(schema.fields + lineage.fields))


def empty_target(spark, spec):
    src = feeds.ods_source(feeds.snapshot_rows(stage(spark, spec, [(1, 1, {})]), spec, audit()), spec, audit())
    extra = {"CreateBy": "string", "CreateDate": "timestamp_ntz", "CreateProcess": "string",
             "UpdateBy": "string", "UpdateDate": "timestamp_ntz", "UpdateProcess": "string",
             "InactiveInd": "boolean", "InactiveReason": "string", "InactiveDate": "timestamp_ntz"}
    return src.limit(0).withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})


def test_every_feed_runs_end_to_end(spark):
    for name, spec in FEEDS.items():
        rows = [(1, 1, {}), (2, 2, {}), (3, 3, {"Cosa": None})]
        out = feeds.run_feed(stage(spark, spec, rows), empty_target(spark, spec), spec, audit())
        v = {r.LineNum: r for r in out["validated"].collect()}
        assert v[3].InactiveInd, name
        assert v[3].InactiveReason.startswith("Validation failure: C"), name
        summary = out["summary"].collect()[0]
        assert summary.rejected == 1, name
        ods = out["ods"].collect()
        # Two loads of one key: the newest wins; the reject is carried, as an insert of its own.
        assert len(ods) == 2 and sum(r.Cosa is None for r in ods) == 1, name
        ods = [r for r in ods if r.Cosa is not None]
        assert out["snapshot"].count() == 3, name      # rejects are carried and re-activated
        if "Queue" in spec.columns and spec.normalize_queue:
            assert ods[0].Queue == "q", name


def test_interval_modes(spark):
    daily, interval = FEEDS["AgentDaily"], FEEDS["AgentInterval"]
    for spec, expected in ((daily, dt.datetime(2024, 6, 1, 8, 0)), (interval, dt.datetime(2024, 6, 1, 13, 0))):
        src = feeds.ods_source(feeds.snapshot_rows(stage(spark, spec, [(1, 1, {})]), spec, audit()), spec, audit())
        r = src.collect()[0]
        assert r.StartInterval == expected
        assert r.UtcStartInterval == dt.datetime(2024, 6, 1, 13, 0)


def test_interval_feed_drops_unparsable_and_checks_online_time(spark):
    spec = FEEDS["AgentInterval"]
    rows = [(1, 1, {"OnlineTime": "1800.5"}), (2, 1, {"OnlineTime": "1800.4", "Agent": "b"})]
    v = {r.LineNum: r for r in feeds.validate_stage(stage(spark, spec, rows), spec).collect()}
    assert v[1].InactiveReason == "Validation failure: OnlineTime Invalid Interval Data"
    assert not v[2].InactiveInd


def test_login_daily_collapses_agents(spark):
    spec = FEEDS["LoginDaily"]
    rows = [(1, 1, {"Agent": "a1"}), (2, 2, {"Agent": "a2"})]
    out = feeds.run_feed(stage(spark, spec, rows), empty_target(spark, spec), spec, audit())
    ods = out["ods"].collect()
    assert [r.Agent for r in ods] == ["a2"]
    assert ods[0].Logout == "06/01/2024 05:00:00 PM"


def test_snapshot_table_function(spark):
    spec = FEEDS["AgentDaily"]
    rows = [(1, 1, {}), (2, 2, {"AgentIdleTime": "7"}),
            (3, 3, {"StartInterval": "2024-07-01T08:00:00Z", "EndInterval": "2024-07-01T08:30:00Z"})]
    snap = feeds.snapshot_rows(stage(spark, spec, rows), spec, audit())
    out = feeds.feed_asof(snap, spec, 3462, F.lit("2024-06-01").cast("timestamp_ntz"),
                          F.lit("2024-06-30").cast("timestamp_ntz")).collect()
    assert len(out) == 1 and out[0].FileLoadAuditId == 1 and str(out[0].AgentIdleTime) in ("7.000000000", "1.000000000")
    assert out[0].ContactsHandled == 1 and out[0].UtcStartInterval == dt.datetime(2024, 6, 1, 13, 0)


def test_partitioned_ods_rewrites_only_touched_partitions(spark, tmp_dir):
    spec = FEEDS["AgentDaily"]
    june = stage(spark, spec, [(1, 1, {}), (2, 1, {"Agent": "b"})])
    july = stage(spark, spec, [(3, 2, {"Agent": "c", "StartInterval": "2024-07-01T08:00:00-05:00",
                                       "EndInterval": "2024-07-01T08:30:00-05:00"})])
    first = feeds.ods_source(feeds.snapshot_rows(june.unionByName(july), spec, audit()), spec, audit())
    initial = feeds.upsert(empty_target(spark, spec), first, ["ParentSystemId", "SystemId", *spec.merge_keys],
                           audit=audit())
    feeds.with_ods_partition(initial, spec).write.partitionBy(*feeds.ods_partitions(spec)).parquet(f"{tmp_dir}/ods")
    july_files = sorted(p.name for p in __import__("pathlib").Path(f"{tmp_dir}/ods").rglob("*.parquet")
                        if "2024-07-01" in str(p))
    # a new delivery for June only: agent 'a' updated, agent 'd' new
    delivery = stage(spark, spec, [(4, 5, {"AgentIdleTime": "9"}), (5, 5, {"Agent": "d"})])
    src = feeds.ods_source(feeds.snapshot_rows(delivery, spec, audit()), spec, audit())
    moved = feeds.merge_ods_partitions(spark, f"{tmp_dir}/ods", src, spec, audit())
    assert moved == ["ParentSystemId=3462/StartMonth=2024-06-01"]
    out = spark.read.parquet(f"{tmp_dir}/ods")
    assert sorted(r.Agent for r in out.collect()) == ["a", "b", "c", "d"]
    assert [str(r.AgentIdleTime) for r in out.where("Agent = 'a'").collect()] == ["9.000000000"]
    assert sorted(p.name for p in __import__("pathlib").Path(f"{tmp_dir}/ods").rglob("*.parquet")
                  if "2024-07-01" in str(p)) == july_files


def test_sql_table_functions_for_all_feeds(spark):
    snaps = {}
    for name, spec in FEEDS.items():
        snaps[name] = feeds.snapshot_rows(stage(spark, spec, [(1, 1, {}), (2, 2, {"Agent": "b"})]), spec, audit())
    names = feeds.register_feed_functions(spark, snaps)
    assert len(names) == 12 and "ft_AgentDailyFileSnapshot_3462" in names
    rows = spark.sql("SELECT * FROM ft_AgentDailyFileSnapshot_3462("
                     "TIMESTAMP_NTZ'2024-06-01 00:00:00', TIMESTAMP_NTZ'2024-06-30 00:00:00')").collect()
    assert sorted(r.Agent for r in rows) == ["a", "b"]
    assert spark.sql("SELECT count(*) AS n FROM ft_AgentDailyFileSnapshot_3463("
                     "TIMESTAMP_NTZ'2024-06-01 00:00:00', TIMESTAMP_NTZ'2024-06-30 00:00:00')").collect()[0].n == 0
