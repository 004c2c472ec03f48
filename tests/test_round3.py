"""Round 3: what a published file list and a repeated run cost."""
import contextlib
import io

from pyspark.sql import functions as F

from wharf.plans import feeds, queries_feed
from wharf.plans.feeds import FEEDS
from wharf.plans.queries_feeds7 import QUERIES, feed_stage
from wharf.session import wide_rows_session
from wharf.sources.versions import VersionedTable

SF = "/root/testdata/sf0.001"


def explained(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_file_names_are_taken_of_files_not_of_rows(spark, tmp_dir):
    """no regular expression runs over a path for every row."""
    table = VersionedTable(spark, f"{tmp_dir}/a b/t", ["id"])
    table.publish(spark.range(0, 1000, 1, 3))
    run = table.files().first()["file"].split("/")[0]
    listed = table._describe(run, table.read().schema)
    assert "regexp" not in explained(listed)
    assert sorted(r["n_rows"] for r in listed.collect()) == [333, 333, 334]
    names = {r["file"] for r in table.files().collect()}
    assert len(names) == 3 and all(n.count("/") == 1 and n.startswith(f"{run}/part-") for n in names)
    assert table.read(sorted(names)).count() == 1000


def test_wide_feeds_run_in_a_session_that_compiles_them(spark):
    """F3, F4, F5, F8, F10, F11: methods beyond the JVM's limit are not generated; the caller's settings stay."""
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        other = wide_rows_session(spark)
        assert other.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        assert other.conf.get("spark.sql.shuffle.partitions") == "5"
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    made = QUERIES["M-14_AgentDaily_feed"](spark, SF)
    assert made.sparkSession.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_repeated_run_is_recognised_before_its_stage_is_written(spark, tmp_dir):
    """a batch that both tables hold costs no second validation."""
    spec, audit = FEEDS["AgentInterval"], queries_feed.fixed_audit()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(200)
    ods = feeds.ods_table(spark, f"{tmp_dir}/ods", spec)
    latest = feeds.latest_table(spark, f"{tmp_dir}/latest", spec)
    first = feeds.run_feed_on_tables(feed_stage(lines, spec), ods, latest, spec, ("runs", 1), audit)
    kept = (ods.current(), latest.current())
    again = feeds.run_feed_on_tables(feed_stage(lines, spec), ods, latest, spec, ("runs", 1), audit)
    assert (ods.current(), latest.current()) == kept
    assert not any("AgentInterval_stage" in f for f in again["validated"].inputFiles())
    for name in ("validated", "summary", "snapshot"):
        assert again[name].exceptAll(first[name].select(again[name].columns)).count() == 0
        assert again[name].count() == first[name].count()
