"""Recoverable tables, merge into files, histories, ledger, rejects and observed summaries."""
import contextlib
import datetime as dt
import io
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from tests.test_sources_streaming import write_csv
from wharf.functions import casts
from wharf.operators import history, merge_files
from wharf.operators.upsert import Audit
from wharf.operators.validate import ObservedSummary, summarize
from wharf.plans import feeds, queries_feed
from wharf.plans.feeds import FEEDS
from wharf.sources import stage
from wharf.sources.ledger import FileLedger
from wharf.sources.versions import VersionedTable
from wharf.streaming.intake import process_batch
from wharf.sources.stage import _BLOCK, _FILE

SF = "/root/testdata/sf0.001"


def explained(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


class Lost(Exception):
    """The driver is gone."""


STEPS = ["write", "_list", "_point"]


@pytest.mark.parametrize("step, done", [(s, d) for s in STEPS for d in (False, True)])
def test_replay_after_a_lost_driver(spark, tmp_dir, monkeypatch, step, done):
    """A batch lost before or after any step of the publication, then repeated, gives the exact ODS."""
    spec = FEEDS["LoginDaily"]

    def batch(n):
        rows = [("c", "co", f"a{i}", f"{n}", "l", f"rp{i % 3}", "x", "Jun 1, 2024 5:00:00 PM", str(i)) for i in range(4 + n)]
        df = spark.createDataFrame(rows, stage.string_schema(spec.columns))
        return df.select("*", F.lit("file:/f.csv").alias(_FILE), F.lit(n).cast("long").alias(_BLOCK),
                         F.lit("2024-06-01").cast("timestamp_ntz").alias("FileEffectiveDate"))

    def run(n):
        process_batch(spark, batch(n), n, spec, 3462, 3464, f"{tmp_dir}/snap", f"{tmp_dir}/ods", stream="s")

    def rows():
        out = feeds.ods_table(spark, f"{tmp_dir}/ods", spec).read()
        return sorted((r.Agent, r.FirstName, r.Duration, r.InactiveInd) for r in out.collect())

    run(0)
    before = rows()
    real = getattr(VersionedTable, step)

    def lost(self, *a):
        if done:
            real(self, *a)
        raise Lost

    monkeypatch.setattr(VersionedTable, step, lost)
    with pytest.raises(Lost):
        run(1)
    monkeypatch.undo()
    published = step == "_point" and done
    assert (rows() == before) is not published                 # one whole version or the other
    run(1)
    after = rows()
    assert len(after) == 5 and {r[1] for r in after} == {"1"}
    run(1)
    run(0)                                                     # an epoch before the last one
    assert rows() == after
    table = feeds.ods_table(spark, f"{tmp_dir}/ods", spec)
    table.vacuum()
    assert rows() == after and table.vacuum() == 0


def test_versions_are_taken_once(spark, tmp_dir):
    table = VersionedTable(spark, f"{tmp_dir}/t", ["k"])
    assert table.current() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, v string")
    assert table.publish(df) == 1
    stale = dict(table.current())
    assert table.publish(df, []) == 2 and table.read().count() == 6
    with pytest.raises(RuntimeError, match="another run"):
        table._point({**stale, "version": 2})
    stats = table.files().agg(F.min("min_k"), F.max("max_k"), F.sum("nulls_k"), F.sum("n_rows")).first()
    assert tuple(stats) == (1, 2, 2, 6)
    old = [r.file for r in table.files().collect()][:1]
    table.publish(df.where("k = 1"), old)
    assert VersionedTable(spark, f"{tmp_dir}/t").read().count() < 7
    table.publish(df.limit(0))
    assert table.read().collect() == [] and table.read().columns == ["k", "v"]


def test_merge_reads_and_exchanges_only_what_can_match(spark, tmp_dir):
    """Files out of range or without a key are not opened; rows that cannot match are not exchanged."""
    spec = FEEDS["AgentQueueDaily"]
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    from wharf.plans.queries_feeds7 import feed_stage, legacy_ods
    audit = queries_feed.fixed_audit()
    snap = feeds.snapshot_rows(feed_stage(lines, spec, plain=True), spec, audit)
    target = legacy_ods(feeds.ods_source(snap, spec, audit), spec)
    table = feeds.ods_table(spark, f"{tmp_dir}/ods", spec)
    table.publish(target.repartitionByRange(12, "StartInterval"))
    delivered = snap.where(F.col("StartInterval").startswith("1996-03"))
    source = feeds.ods_source(delivered, spec, audit)
    source.write.parquet(f"{tmp_dir}/src")
    source = spark.read.parquet(f"{tmp_dir}/src")
    keys, update = feeds.ods_keys(spec), feeds.ods_updates(source, spec)
    files, merged = merge_files.merged_files(table, source, keys, update, audit)
    assert 0 < len(files) <= 2 and len(merge_files.files_in_range(table, source)) <= 2
    read = {pathlib.PurePath(f).name for f in merged.inputFiles() if "/ods/data/" in f}
    assert read == {pathlib.PurePath(f).name for f in files}
    plan = explained(merged)
    union = plan[plan.index("Union"):plan.index("(1)")]
    copied = union[union.rindex("+- ") if "AdaptiveSparkPlan" not in union else union.rindex("   +- "):]
    assert "Exchange" not in copied                            # the rows copied in place
    near = merge_files.touched_rows(table, source, keys, F.col("InactiveInd") == F.lit(False))[1]
    assert near.count() <= 1.1 * source.count() < 0.2 * target.count()
    want = feeds.merge_ods(target, source, spec, audit)
    table.publish(merged, files)
    assert table.read().exceptAll(want).count() == 0 and table.read().count() == want.count()


def test_merge_into_files_keeps_merge_semantics(spark, tmp_dir):
    """NULL keys, a NULL in the range column, several source rows, an empty delivery."""
    schema = "k string, d timestamp_ntz, v int, InactiveInd boolean, InactiveReason string, InactiveDate timestamp"
    day = dt.datetime(2024, 1, 1)
    stamps = {c: F.lit(None).cast("string") for c in ("CreateBy", "CreateProcess", "UpdateBy", "UpdateProcess")}
    stamps |= {c: F.lit(None).cast("timestamp") for c in ("CreateDate", "UpdateDate")}
    target = spark.createDataFrame([("a", day, 1, False, "", None), (None, day, 2, False, "", None),
                                    ("b", None, 3, False, "", None), ("c", day, 4, True, "x", None)], schema).withColumns(stamps)
    for null_safe, want in ((False, 7), (True, 5)):
        table = VersionedTable(spark, f"{tmp_dir}/{null_safe}", ["d"])
        table.publish(target.repartition(3))
        source = spark.createDataFrame([("a", day, 10), (None, day, 20), ("b", None, 30), ("c", day, 40)], "k string, d timestamp_ntz, v int")
        merge_files.merge_into(table, source, ["k", "d"], ["v"], Audit(), null_safe=null_safe)
        got = table.read().collect()
        assert len(got) == want
        values = sorted((r.k or "", r.v) for r in got)
        assert ("a", 10) in values and ("c", 4) in values and ("c", 40) in values and ("a", 1) not in values
        merge_files.merge_into(table, source.limit(0), ["k", "d"], ["v"], Audit())
        assert table.read().count() == want
    with pytest.raises(Exception, match="several source rows"):
        merge_files.merge_into(table, source.unionByName(source), ["k", "d"], ["v"], Audit())
    assert table.read().count() == want


def test_history_at_a_past_time(spark, tmp_dir):
    """Intervals after three runs, one of them late, against a window over all rows."""
    import random
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(6)}" if rng.random() > .1 else None, dt.datetime(2024, 1, rng.randint(1, 9)), i, i % 3)
            for i in range(90)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, n int, run int")
    table = VersionedTable(spark, f"{tmp_dir}/h", ["k"])
    for batch, run in enumerate((1, 2, 0)):
        for _ in range(2):
            history.record_run(table, df.where(F.col("run") == run), ["k"], ["t"], ["n"], ("h", batch))
    for day in (None, 1, 3, 5, 9):
        at = None if day is None else F.lit(dt.datetime(2024, 1, day))
        got = sorted((r.k or "", r.n) for r in history.valid_at(table.read(), at).collect())
        best = {}
        for k, t, n, _ in rows:
            if day is None or t <= dt.datetime(2024, 1, day):
                best[k] = max(best.get(k, (t, n)), (t, n))
        assert got == sorted((k or "", n) for k, (_, n) in best.items())
    lo, hi = (F.lit(v).cast("string") for v in ("k0", "k9"))
    assert "Window" not in explained(history.valid_at(table.read(history.files_between(table, "k", lo, hi)), at))


def test_latest_rows_by_delivery(spark, tmp_dir):
    """Only rows that the delivery won come back, also when the run is repeated."""
    table = VersionedTable(spark, f"{tmp_dir}/latest", ["key_0", history.BATCH])
    runs = [[("a", 1, 5), ("b", 1, 5), (None, 1, 5)], [("a", 2, 4), ("b", 2, 6), (None, 2, 6), ("c", 2, 0)], [("c", 3, 0)]]
    won = []
    for n, rows in enumerate(runs):
        df = spark.createDataFrame(rows, "k string, v int, t int")
        for _ in range(2):
            got = history.advance_latest(table, df, [F.col("k")], ["t"], [], ("l", n))
        won.append(sorted((r.k or "", r.v) for r in got.collect()))
    assert won == [[("", 1), ("a", 1), ("b", 1)], [("", 2), ("b", 2), ("c", 2)], [("c", 3)]]
    assert sorted((r.k or "", r.v) for r in table.read().collect()) == [("", 2), ("a", 1), ("b", 2), ("c", 3)]


def test_ledger_statuses(spark, tmp_dir):
    """New, grown, touched without change, and nothing to do."""
    ledger = FileLedger(spark, f"{tmp_dir}/ledger")
    a, b = f"{tmp_dir}/in/3462/a.csv", f"{tmp_dir}/in/3463/b.csv"
    write_csv(a, ["x"], [["1"]])
    write_csv(b, ["x"], [["2"]])
    write_csv(f"{tmp_dir}/in/notes.txt", ["x"], [["2"]])

    def run(n):
        taken = ledger.take(f"{tmp_dir}/in", "*.csv")
        names = ledger.to_load(taken)
        counts = spark.createDataFrame([(f, 1) for f in names], "file string, n_rows long")
        ledger.record(taken, counts, n)
        return sorted((pathlib.PurePath(r.file).name, r.status) for r in taken.collect()), len(names)

    assert run(1) == ([("a.csv", "new"), ("b.csv", "new")], 2)
    assert run(2) == ([], 0)
    write_csv(a, ["x"], [["1"], ["3"]])
    os.utime(b, (1e9, 1e9))
    assert run(3) == ([("a.csv", "redelivered"), ("b.csv", "touched")], 1)
    assert run(4) == ([], 0)
    entries = ledger.entries().collect()
    assert len(entries) == 4 and [r.n_rows for r in entries if r.status == "touched"] == [None]


def test_rejects_keep_line_and_text(spark, tmp_dir):
    path = f"{tmp_dir}/in/s.csv"
    os.makedirs(os.path.dirname(path))
    lines = ["a,b,c", "1,2,3", "4,5", "6,7,8,9", '"10,11,12', "13,,15"]
    pathlib.Path(path).write_text("\n".join(lines) + "\n")
    kw = dict(parent_id=1, system_id=2, audit_id=3)
    good = stage.read_stage(spark, f"{tmp_dir}/in", ["a", "b", "c"], keep_malformed=False, **kw)
    bad = stage.read_rejects(spark, f"{tmp_dir}/in", ["a", "b", "c"], **kw)
    assert sorted((r.LineNum, r.a) for r in good.collect()) == [(1, "1"), (5, "13")]
    assert sorted((r.LineNum, r.RawRecord) for r in bad.collect()) == list(zip((2, 3, 4), lines[2:5]))
    assert bad.select("RawRecord").count() == 3 and good.select("b").count() == 2   # whatever is read
    assert stage.read_stage(spark, f"{tmp_dir}/in", ["a", "b", "c"], **kw).count() == 5
    both = summarize(good.unionByName(bad, allowMissingColumns=True), None, ("ParentSystemId", "SystemId"))
    assert [tuple(r) for r in both.collect()] == [(1, 2, 3)]


def test_observed_summary_needs_no_second_scan(spark):
    made = spark.createDataFrame([(1, 2, "2024-06-01T00:00:00", False), (1, 2, "bad", True), (3, 4, None, None)],
                                 "ParentSystemId long, SystemId long, d string, InactiveInd boolean")
    by = ("ParentSystemId", "SystemId")
    seen = ObservedSummary("d", by, [(1, 2), (3, 4), (5, 6)])
    seen.watch(made).write.format("noop").mode("overwrite").save()
    got = seen.rows(spark)
    assert sorted(got.collect()) == sorted(summarize(made, "d", by).collect()) and got.dtypes == summarize(made, "d", by).dtypes
    missing = ObservedSummary("d", by, [(1, 2)])
    missing.watch(made).write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError, match="no known group"):
        missing.rows(spark)


@pytest.mark.parametrize("text", ["1.5d", "2f", "0x1p3", "NaN", "1 2", ""])
def test_strict_counts_take_plain_numbers_only(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed|cannot be cast"):
        df.select(casts.int_from_float_round("s")).collect()
    good = spark.createDataFrame([("2.5",), ("-2.5",), (" 1e2 ",), ("+.5",), ("3.",), (None,)], "s string")
    assert [r[0] for r in good.select(casts.int_from_float_round("s")).collect()] == [3, -3, 100, 1, 3, None]


@pytest.mark.parametrize("text", ["2024", "2024-06", "2024-06-01", "2024-06-01 00:00:00", "T10:00:00", ""])
def test_strict_wall_times_are_whole(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        df.select(casts.wall_datetime("s", safe=False)).collect()
    good = spark.createDataFrame([("2024-06-01T10:00:00-05:00",), (None,)], "s string")
    assert [r[0] for r in good.select(casts.wall_datetime("s", safe=False)).collect()] == [dt.datetime(2024, 6, 1, 10), None]


def test_shares_of_wide_amounts(spark):
    """Against exact arithmetic, up to 28 digits before the point."""
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    from wharf.operators.allocate import share_product
    made = [(m, s) for m in ("9999999999999999999999999998.999999999", "-9200000000000000000000000001.5", "0.000000001",
                             "12345678901234567890123456.123456789", "999999999.999999999", "0")
            for s in ("0.333333333", "1", "0.000000001", "1.5", None) if abs(float(m) * float(s or 1)) < 1e28]
    df = spark.createDataFrame(made, "m string, s string").select(
        F.col("m").cast("decimal(38,9)").alias("m"), F.col("s").cast("decimal(13,9)").alias("s"))
    with localcontext() as ctx:
        ctx.prec = 80
        want = [(Decimal(m) * Decimal(s or 1)).quantize(Decimal("1e-9"), ROUND_HALF_UP) for m, s in made]
    assert [r[0] for r in df.select(share_product(F.col("m"), F.col("s"))).collect()] == want
    narrow = df.where(F.abs("m") < 10 ** 9).select(F.col("m").cast("decimal(18,9)").alias("m"), "s")
    types = (narrow.schema["m"].dataType, narrow.schema["s"].dataType)
    both = narrow.select(share_product(F.col("m"), F.col("s"), types).alias("a"), share_product(F.col("m"), F.col("s")).alias("b"))
    assert both.where("NOT a <=> b").count() == 0 and both.count() == 10 + 5 * 1


def test_views_are_published_in_order(spark):
    """Inputs first; after a change only what the changed input reaches."""
    from graphlib import CycleError

    from wharf.plans import views
    gdp = spark.createDataFrame([("GDP", "Current", "m", "a", 1.0, "x", 2024)],
                                "Type string, Current_Prev string, Market string, Attribute string, Average double, DataAsOf string, Year int")
    gdp.createOrReplaceTempView("t_gdp")
    spark.createDataFrame([("m", 5)], "Market_Description string, market_dim_key long").createOrReplaceTempView("t_markets")
    spark.createDataFrame([(2024, "l", 1.0, 2.0, 3.0, "x")],
                          "CY int, Label string, Prior_Forecast double, Current_Forecast double, QoQ double, DataAsOf string").createOrReplaceTempView("t_outlook")
    graph = {"v_late": ("view6", ("v_outlook",)), "v_outlook": ("view6", ("t_outlook",)), "v_gdp": ("view4", ("t_gdp", "t_markets"))}
    order = views.publish_graph(spark, graph)
    assert sorted(order) == sorted(graph) and order.index("v_outlook") < order.index("v_late")
    assert spark.table("v_gdp").collect()[0].market_dim_key == 5 and spark.table("v_late").count() == 1
    spark.createDataFrame([("m", 6)], "Market_Description string, market_dim_key long").createOrReplaceTempView("t_markets")
    assert views.publish_graph(spark, graph, {"t_markets"}) == ["v_gdp"]
    assert spark.table("v_gdp").collect()[0].market_dim_key == 6
    assert views.publication_order(graph, {"t_outlook"}) == ["v_outlook", "v_late"] and views.publication_order(graph, set()) == []
    with pytest.raises(CycleError):
        views.publication_order({"a": ("view6", ("b",)), "b": ("view6", ("a",))})


def test_stream_without_repeats(spark, tmp_dir):
    """Repeats within the delay go, late rows go, a key comes again after its state expired."""
    from wharf.streaming.intake import unique_rows

    def day(d, h=0):
        return dt.datetime(2024, 1, d, h)

    batches = [[("a", 1, day(10)), ("a", 2, day(10, 1)), ("b", 3, day(10)), (None, 4, day(10)), (None, 5, day(10))],
               [("a", 6, day(10, 2)), ("c", 7, day(11))],
               [("d", 8, day(20)), ("d", 9, day(20))],
               [("e", 10, day(12)), ("b", 11, day(20)), ("a", 12, day(21))]]     # e is late; a and b have expired
    schema = "k string, n long, t timestamp"
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_dir}/in")
        (unique_rows(stream, ["k"], "t", "2 days").writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start().awaitTermination())
        got.append(sorted(r.k or "" for r in spark.read.schema(schema).parquet(f"{tmp_dir}/out").collect()))
    assert got == [["", "a", "b"], ["", "a", "b", "c"], ["", "a", "b", "c", "d"], ["", "a", "a", "b", "b", "c", "d"]]
