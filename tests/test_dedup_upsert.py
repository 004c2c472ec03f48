import datetime as dt

from pyspark.sql import functions as F

from wharf.operators.dedup import duplicates, latest_per_key
from wharf.operators.upsert import Audit, assert_unique, upsert

NOW = dt.datetime(2024, 6, 30)


def audit():
    return Audit(now=F.lit(NOW).cast("timestamp_ntz"), user=F.lit("tester"), process="test")


def test_latest_per_key_newest_wins(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")],
                               "key string, LoadDate int, v string")
    got = {r.key: r.v for r in latest_per_key(df, ["key"], ["LoadDate"]).collect()}
    assert got == {"k": "new", "j": "only"}


def test_reduced_key_collapses_agents(spark):
    df = spark.createDataFrame([("a1", "p", "60", 1), ("a2", "p", "60", 2)],
                               "Agent string, RoutingProfile string, Duration string, LoadDate int")
    out = latest_per_key(df, ["RoutingProfile", "Duration"], ["LoadDate"]).collect()
    assert [r.Agent for r in out] == ["a2"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in duplicates(df, ["k"]).collect()] == [(1, 2)]
    assert assert_unique(df, ["k"]).count() == 1


def _target(spark):
    rows = [("k1", "c1", 1.0, False, "", None, "old", NOW - dt.timedelta(days=9)),
            ("k2", "c1", 2.0, True, "gone", NOW - dt.timedelta(days=5), "old", NOW - dt.timedelta(days=9)),
            (None, "c1", 3.0, False, "", None, "old", NOW - dt.timedelta(days=9))]
    return spark.createDataFrame(rows, "Agent string, Company string, v double, InactiveInd boolean, "
                                       "InactiveReason string, InactiveDate timestamp_ntz, CreateBy string, "
                                       "CreateDate timestamp_ntz").withColumns(
        {"UpdateBy": F.lit("old"), "UpdateDate": F.col("CreateDate"), "UpdateProcess": F.lit("p"),
         "CreateProcess": F.lit("p")})


def _source(spark):
    return spark.createDataFrame([("k1", "c1", 10.0), ("k2", "c1", 20.0), (None, "c1", 30.0), ("k3", "c1", 40.0)],
                                 "Agent string, Company string, v double")


def test_upsert_semantics(spark):
    out = upsert(_target(spark), _source(spark), ["Agent", "Company"], audit=audit()).collect()
    by = {}
    for r in out:
        by.setdefault((r.Agent, r.InactiveInd), []).append(r)
    # active match: updated, flags untouched, Create* overwritten (reference behaviour)
    (k1,) = by[("k1", False)]
    assert k1.v == 10.0 and k1.CreateBy == "tester" and k1.UpdateDate == NOW
    # inactive target is never revived: unchanged, plus a new active row
    (k2_old,) = by[("k2", True)]
    (k2_new,) = by[("k2", False)]
    assert k2_old.v == 2.0 and k2_old.InactiveReason == "gone" and k2_new.v == 20.0
    # NULL key never matches: old row kept, source row inserted again
    assert sorted(r.v for r in by[(None, False)]) == [3.0, 30.0]
    assert [r.v for r in by[("k3", False)]] == [40.0]
    assert len(out) == 6


def test_upsert_preserve_created_and_null_safe(spark):
    out = upsert(_target(spark), _source(spark), ["Agent", "Company"], audit=audit(),
                 preserve_created=True, null_safe=True).collect()
    k1 = [r for r in out if r.Agent == "k1"][0]
    assert k1.CreateBy == "old" and k1.UpdateBy == "tester"
    assert sorted(r.v for r in out if r.Agent is None) == [30.0]


def test_upsert_idempotent(spark):
    cols = ["Agent", "Company", "v", "InactiveInd", "InactiveReason"]
    once = upsert(_target(spark), _source(spark), ["Agent", "Company"], audit=audit())
    twice = upsert(once, _source(spark), ["Agent", "Company"], audit=audit())
    key = lambda rows: sorted((tuple(str(x) for x in r) for r in rows))
    # the NULL-key row is inserted again each run (reference behaviour): compare the rest
    a = [r for r in once.select(cols).collect() if r.Agent is not None]
    b = [r for r in twice.select(cols).collect() if r.Agent is not None]
    assert key(a) == key(b)


def test_hot_key_and_null_heavy_key(spark):
    """A third of the rows on one key (and a third with a NULL key) stay whole and correct."""
    n = 3000
    rows = [("hot" if i % 3 == 0 else (None if i % 3 == 1 else f"k{i}"), "c1", float(i)) for i in range(n)]
    src = spark.createDataFrame(rows, "Agent string, Company string, v double")
    latest = latest_per_key(src, ["Agent", "Company"], [F.col("v").desc()])
    got = {r.Agent: r.v for r in latest.where("Agent = 'hot'").collect()}
    assert got == {"hot": float(n - 3)}
    assert latest.count() == 1 + 1 + n // 3          # hot, the NULL group, the distinct keys
    deduped = latest
    out = upsert(_target(spark), deduped, ["Agent", "Company"], audit=audit())
    # NULL-key rows never match: the target's NULL row stays, the source's NULL row is inserted
    assert out.where("Agent IS NULL").count() == 2
    assert out.where("Agent = 'hot'").count() == 1
    # every target row stays (k1 untouched, k2 inactive, NULL) and all 2 + n//3 source rows insert:
    # none of them matches an active target key ('k2' only exists inactive in the target)
    assert out.count() == 3 + (2 + n // 3)
