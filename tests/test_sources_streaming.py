import os

from pyspark.sql import functions as F

from wharf.plans.feeds import FEEDS
from wharf.sources.layers import append_snapshot, read_shards, rebuild_table, run_audit, union_shards
from wharf.sources.stage import read_stage
from wharf.sources.versions import VersionedTable
from wharf.streaming.intake import incremental_intake


def write_csv(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_read_stage_line_numbers(spark, tmp_dir):
    spec = FEEDS["LoginDaily"]
    for name, n in (("a Month To Date Extracts 1.csv", 5), ("b Month To Date Extracts 2.csv", 3), ("skip.txt", 2)):
        write_csv(f"{tmp_dir}/3462/3464/LoginDaily/{name}", spec.columns,
                  [[f"c{i}", "co", f"a{i}", "f", "l", "rp", "x", '"Jun 1, 2024 5:00:00 PM"', str(i)] for i in range(n)])
    df = read_stage(spark, tmp_dir, spec.columns, parent_id=3462, system_id=3464, audit_id=9, mask="*Extracts*.csv")
    rows = df.collect()
    assert len(rows) == 8
    assert sorted(r.LineNum for r in rows) == [1, 1, 2, 2, 3, 3, 4, 5]
    assert all(r.Cosa == f"c{r.LineNum - 1}" for r in rows)
    assert {r.Logout for r in rows} == {"Jun 1, 2024 5:00:00 PM"}
    assert {r.FileLoadAuditId for r in rows} == {9}


def test_layers_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(3462, "x"), (3463, "y")], "ParentSystemId bigint, v string")
    append_snapshot(df, f"{tmp_dir}/snap")
    append_snapshot(df, f"{tmp_dir}/snap")
    assert read_shards(spark, f"{tmp_dir}/snap", [3462]).count() == 2
    rebuild_table(df, f"{tmp_dir}/t")
    rebuild_table(spark.read.parquet(f"{tmp_dir}/t").where("v = 'x'"), f"{tmp_dir}/t")
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 1
    u = union_shards([df, df.drop("v")])
    assert u.where(F.col("v").isNull()).count() == 2
    summary = spark.createDataFrame([(3462, 2)], "ParentSystemId bigint, rejected bigint")
    audit = run_audit(summary, 1, "job").collect()[0]
    assert audit.RunId == 1 and audit.InactiveReason == "2 rows rejected"


def test_incremental_intake_is_idempotent(spark, tmp_dir):
    spec = FEEDS["LoginDaily"]
    landing, snap, ods, ckpt = (f"{tmp_dir}/{x}" for x in ("landing", "snap", "ods", "ckpt"))
    rows = [[f"c{i}", "co", f"a{i}", "f", "l", "rp", "x", '"Jun 1, 2024 5:00:00 PM"', str(i)] for i in range(4)]
    write_csv(f"{landing}/f1.csv", spec.columns, rows)
    q = incremental_intake(spark, landing, spec, parent_id=3462, system_id=3464, snapshot_path=snap,
                           ods_path=ods, checkpoint=ckpt)
    q.awaitTermination(120)
    assert VersionedTable(spark, ods).read().count() == 4
    # the month-to-date file is delivered again (same rows, new file): still 4 ODS rows
    write_csv(f"{landing}/f2.csv", spec.columns, rows)
    q = incremental_intake(spark, landing, spec, parent_id=3462, system_id=3464, snapshot_path=snap,
                           ods_path=ods, checkpoint=ckpt)
    q.awaitTermination(120)
    out = VersionedTable(spark, ods).read()
    assert out.count() == 4 and out.where("InactiveInd").count() == 0
    assert spark.read.parquet(snap).count() == 8


def test_intake_with_only_rejected_rows(spark, tmp_dir):
    spec = FEEDS["LoginDaily"]
    landing = f"{tmp_dir}/landing"
    write_csv(f"{landing}/f1.csv", spec.columns, [["", "co", "", "f", "l", "rp", "x", "y", "z"]])
    q = incremental_intake(spark, landing, spec, parent_id=3462, system_id=3464,
                           snapshot_path=f"{tmp_dir}/snap", ods_path=f"{tmp_dir}/ods", checkpoint=f"{tmp_dir}/ck", carry_rejects=False)
    q.awaitTermination(120)
    assert q.exception() is None
    # no row passed validation: the ODS holds no data files yet
    assert not list(__import__("pathlib").Path(f"{tmp_dir}/ods").rglob("*.parquet"))
    write_csv(f"{landing}/f2.csv", spec.columns, [["c", "co", "a", "f", "l", "rp", "x", "y", "5"]])
    q = incremental_intake(spark, landing, spec, parent_id=3462, system_id=3464,
                           snapshot_path=f"{tmp_dir}/snap", ods_path=f"{tmp_dir}/ods", checkpoint=f"{tmp_dir}/ck", carry_rejects=False)
    q.awaitTermination(120)
    assert q.exception() is None and VersionedTable(spark, f"{tmp_dir}/ods").read().count() == 1


def test_route_by_folder(spark, tmp_dir):
    from wharf.sources.stage import route_by_folder
    write_csv(f"{tmp_dir}/AgentDaily/a.csv", ["x"], [["1"]])
    write_csv(f"{tmp_dir}/LoginDaily/b.csv", ["x"], [["2"]])
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(tmp_dir)
    got = sorted(r.feed for r in df.select(route_by_folder().alias("feed")).collect())
    assert got == ["AgentDaily", "LoginDaily"]


def test_documented_batch_flow(spark, tmp_dir):
    from pyspark.sql import functions as F

    from wharf.operators.upsert import Audit
    from wharf.plans.feeds import run_feed
    from wharf.sources.layers import append_snapshot, rebuild_table

    spec = FEEDS["LoginDaily"]
    rows = [[f"c{i}", "co", f"a{i}", "f", "l", "rp", "x", '"Jun 1, 2024 5:00:00 PM"', str(i)] for i in range(3)]
    write_csv(f"{tmp_dir}/landing/day1/Login Extracts 1.csv", spec.columns, rows)
    ods, snap = f"{tmp_dir}/ods", f"{tmp_dir}/snapshot"
    empty = spark.createDataFrame([], "ParentSystemId bigint, SystemId bigint, Cosa string, Company string, "
                                      "Agent string, FirstName string, LastName string, RoutingProfile string, "
                                      "Login string, Logout string, Duration decimal(38,9), LoadBy string, "
                                      "LoadDate timestamp, LoadProcess string, CreateBy string, CreateDate timestamp, "
                                      "CreateProcess string, UpdateBy string, UpdateDate timestamp, "
                                      "UpdateProcess string, InactiveInd boolean, InactiveReason string, "
                                      "InactiveDate timestamp")
    rebuild_table(empty, ods)
    for day in ("day1", "day2"):
        if day == "day2":  # the month-to-date file arrives again with one changed row
            rows[0][1] = "co2"
            write_csv(f"{tmp_dir}/landing/day2/Login Extracts 2.csv", spec.columns, rows)
        stage = read_stage(spark, f"{tmp_dir}/landing/{day}", spec.columns, parent_id=3462,
                           system_id=3464, audit_id=1, mask="*Extracts*.csv")
        history = spark.read.parquet(snap) if day == "day2" else None
        out = run_feed(stage, spark.read.parquet(ods), spec, Audit(process="daily"), history=history)
        append_snapshot(out["snapshot"], snap)
        rebuild_table(out["ods"], ods)
    result = spark.read.parquet(ods)
    # co2 is a new business key (Company changed), so it is inserted beside the old row
    assert result.count() == 4
    assert result.where(F.col("Company") == "co2").count() == 1
    assert spark.read.parquet(snap).count() == 6


def test_line_numbers_across_file_splits(spark, tmp_dir):
    """A file read as many splits still gets 1..n line numbers in file order."""
    spec = FEEDS["LoginDaily"]
    n = 4000
    write_csv(f"{tmp_dir}/big/Extracts.csv", spec.columns,
              [[f"c{i}", "co", f"a{i}", "f", "l", "rp", "x", "y", str(i)] for i in range(n)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 * 1024))
    try:
        splits = spark.read.option("header", True).csv(f"{tmp_dir}/big").rdd.getNumPartitions()
        assert splits > 1
        df = read_stage(spark, f"{tmp_dir}/big", spec.columns, parent_id=1, system_id=2, audit_id=3)
        rows = df.select("LineNum", "Duration").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n
    assert all(r.LineNum == int(r.Duration) + 1 for r in rows)
