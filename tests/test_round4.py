"""Round 4: what feeds and histories leave on disk while they run."""
import contextlib
import io
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wharf.operators import slices
from wharf.operators.upsert import Audit, upsert
from wharf.plans import feeds, queries_feed
from wharf.plans.feeds import FEEDS
from wharf.plans.queries_feeds7 import feed_stage, legacy_ods
from wharf.session import shared_folder
from wharf.sources.versions import VersionedTable

SF = "/root/testdata/sf0.001"


def same(a, b) -> bool:
    b = b.select(a.columns)
    return a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def shuffle_files(spark) -> int:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.startswith("shuffle_") and f.endswith(".data")
               for d in manager.localDirs() for _, _, names in os.walk(d.getPath()) for f in names)


def scratch(spark, name: str) -> list[str]:
    folder = shared_folder(spark).removeprefix("file:") + "/wharf-tables"
    return [n for n in os.listdir(folder) if n.startswith(name)] if os.path.isdir(folder) else []


@pytest.mark.parametrize("name", ["AgentInterval", "LoginDaily"])
def test_a_feed_in_slices_gives_the_same_ods(spark, monkeypatch, name):
    """a large feed is merged and written slice by slice, with the same rows."""
    spec, audit = FEEDS[name], queries_feed.fixed_audit()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 30 = 0")
    odd = F.col("l_linenumber") % 2 == 1
    history = feeds.snapshot_rows(feed_stage(lines.where(odd), spec), spec, audit)
    target = legacy_ods(feeds.ods_source(history, spec, audit), spec)
    delivery = feed_stage(lines.where(~odd), spec)
    whole = feeds.run_feed(delivery, target, spec, audit, history=history)["ods"]
    assert not any(f"{name}_ods" in f for f in whole.inputFiles())
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    assert slices.slice_count(lines.count()) > 2
    parts = feeds.run_feed(delivery, target, spec, audit, history=history)["ods"]
    assert all(f"{name}_ods" in f for f in parts.inputFiles())
    assert same(parts, whole)


def test_a_merge_in_slices_still_refuses_several_source_rows(spark, monkeypatch, tmp_dir):
    """U-04 holds in every slice; nothing is published."""
    from wharf.operators.merge_files import merge_into
    monkeypatch.setattr(slices, "SLICE_ROWS", 2)
    stamps = {c: F.lit(None).cast("string") for c in ("CreateBy", "CreateProcess", "UpdateBy", "UpdateProcess")}
    stamps |= {c: F.lit(None).cast("timestamp") for c in ("CreateDate", "UpdateDate", "InactiveDate")}
    target = spark.range(10).select("id", F.lit(1).alias("v"), F.lit(False).alias("InactiveInd"), F.lit("").alias("InactiveReason"))
    table = VersionedTable(spark, f"{tmp_dir}/t", ["id"])
    table.publish(target.withColumns(stamps))
    source = spark.range(5, 15).select(F.col("id").cast("int").alias("id"), F.lit(2).alias("v"))
    merge_into(table, source, ["id"])
    assert sorted(tuple(r) for r in table.read().select("id", "v").collect()) == [(i, 1 + (i >= 5)) for i in range(15)]
    with pytest.raises(Exception, match="several source rows"):
        merge_into(table, source.unionByName(source.where("id = 7")), ["id"])
    assert table.current()["version"] == 2 and not scratch(spark, "delivery")


def test_kept_tables_in_slices_leave_no_copies(spark, tmp_dir, monkeypatch):
    """same rows in slices; replaced versions, deliveries and shuffle files do not stay."""
    spec, audit = FEEDS["AgentQueueDaily"], queries_feed.fixed_audit()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 30 = 0")
    odd = F.col("l_linenumber") % 2 == 1

    def run(at, **kw):
        ods = feeds.ods_table(spark, f"{tmp_dir}/{at}/ods", spec)
        latest = feeds.latest_table(spark, f"{tmp_dir}/{at}/latest", spec)
        for n, part in enumerate((odd, ~odd)):
            feeds.run_feed_on_tables(feed_stage(lines.where(part), spec), ods, latest, spec, ("runs", n), audit, **kw)
        return ods, latest

    whole = run("whole")
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    parts = run("parts", vacuum=True)
    for a, b in zip(parts, whole):
        assert same(a.read(), b.read())
        assert a.vacuum() == 0 and b.vacuum() > 0
    assert not scratch(spark, "newest") and not scratch(spark, "delivery")
    latest = parts[1]
    again = feeds.run_feed_on_tables(feed_stage(lines.where(~odd), spec), *parts, spec, ("runs", 1), audit, vacuum=True)
    assert latest.current()["version"] == 2 and again["snapshot"].count() == lines.where(~odd).count()


def test_a_published_table_leaves_no_shuffle_files(spark, tmp_dir):
    """F1 to F7: shuffle files go with the write that made them."""
    rows = spark.range(2000).select(F.pmod("id", F.lit(50)).alias("k"), "id")
    before = shuffle_files(spark)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    table = VersionedTable(spark, f"{tmp_dir}/t", ["k"])
    table.publish([ranked.where("k < 25"), ranked.where("k >= 25")])
    written = [f for f in table.read().inputFiles()]
    assert table.read().count() == 2000 and len({f.split("/")[-2] for f in written}) == 1
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert kept == "false"
    # The list's own small aggregate may leave its files; the window's, of either part, are gone.
    assert shuffle_files(spark) - before <= 2


@pytest.mark.parametrize("name", ["AgentQueueDaily", "QueueRoutingDaily"])
def test_a_history_in_slices_is_the_same(spark, tmp_dir, monkeypatch, name):
    """versions are set slice by slice; their copy goes with the run."""
    spec = FEEDS[name]
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 30 = 0")
    snapshot = feeds.snapshot_rows(feed_stage(lines, spec, plain=True), spec, queries_feed.fixed_audit())

    def run(at):
        table = feeds.history_table(spark, f"{tmp_dir}/{at}")
        for n in (0, 1):
            feeds.record_snapshot(table, snapshot.where(F.col("LineNum") % 2 == n), spec, ("runs", n))
        return table.read()

    whole = run("whole")
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    assert same(run("parts"), whole)
    assert not scratch(spark, "versions")


def test_stamps_are_not_carried_through_the_merge(spark):
    """F1 to F6: what is the same for all source rows is put in after the join."""
    target = spark.range(4).select("id", F.lit("t").alias("v"), F.lit("old").alias("CreateBy"), F.lit("old").alias("UpdateProcess"),
                                   F.lit(False).alias("InactiveInd"), F.lit("").alias("InactiveReason"))
    source = spark.range(2, 6).select("id", F.lit("s").alias("v"), F.lit("own").alias("CreateBy"))
    out = upsert(target, source, ["id"], audit=Audit(now=F.lit("2024-01-01").cast("timestamp"), user=F.lit("who"), process="a-process"))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain(mode="simple")
    lines = text.getvalue().splitlines()
    joined = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line or "HashJoin" in line)
    assert not any("a-process" in line for line in lines[joined:])
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(0, "t", "old", "old", False, ""), (1, "t", "old", "old", False, ""), (2, "s", "who", "a-process", False, ""),
                   (3, "s", "who", "a-process", False, ""), (4, "s", "who", "a-process", False, ""), (5, "s", "who", "a-process", False, "")]
