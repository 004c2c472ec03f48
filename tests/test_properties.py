"""Property tests on small generated inputs."""
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wharf.operators.allocate import allocate
from wharf.operators.dedup import latest_per_key
from wharf.operators.reshape import unpivot_notnull
from wharf.plans import views

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

amounts = st.decimals(min_value=Decimal("0"), max_value=Decimal("99999.99"), places=2)


@SETTINGS
@given(facts=st.lists(st.tuples(st.integers(0, 5), amounts), min_size=1, max_size=30),
       splits=st.dictionaries(st.integers(0, 5), st.integers(1, 99), max_size=6))
def test_allocation_conserves_totals(spark, facts, splits):
    """Shares per key summing to 1 (or no share row) leave the grand total unchanged."""
    share_rows = []
    for k, pct in splits.items():
        a = Decimal(pct) / 100
        share_rows += [(k, "A", a), (k, "B", Decimal(1) - a)]
    f = spark.createDataFrame(facts, "k int, amt decimal(18,2)")
    s = spark.createDataFrame(share_rows, "k int, seg string, pct decimal(10,6)")
    for pre in (True, False):
        out = allocate(f, s, [("k", "k")], {"amt": F.col("amt")}, ["seg_out"], "pct",
                       labels={"seg_out": "seg"}, preaggregate=pre)
        total = out.agg(F.sum("amt")).collect()[0][0]
        assert total == sum(a for _, a in facts)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=40))
def test_latest_per_key_unique_and_newest(spark, rows):
    df = spark.createDataFrame(rows, "k int, j int, load int")
    out = latest_per_key(df, ["k", "j"], ["load"]).collect()
    keys = [(r.k, r.j) for r in out]
    assert len(keys) == len(set(keys)) == len({(k, j) for k, j, _ in rows})
    newest = {}
    for k, j, load in rows:
        newest[(k, j)] = max(newest.get((k, j), load), load)
    assert all(r.load == newest[(r.k, r.j)] for r in out)


@SETTINGS
@given(rows=st.lists(st.tuples(st.none() | st.integers(0, 9), st.none() | st.integers(0, 9),
                               st.none() | st.integers(0, 9)), min_size=1, max_size=20))
def test_unpivot_rows_equal_non_null_cells(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, Stronger_pcnt int, same_pcnt int, weaker_pcnt int")
    out = unpivot_notnull(df, ["id"], ["Stronger_pcnt", "same_pcnt", "weaker_pcnt"])
    assert out.count() == sum(v is not None for r in rows for v in r)


@SETTINGS
@given(years=st.lists(st.integers(2018, 2026), min_size=1, max_size=15))
def test_at_most_the_max_year_is_flagged(spark, years):
    outlook = spark.createDataFrame([(y, f"L{i}", 1.0, 2.0, 1.0, "x") for i, y in enumerate(years)],
                                    "CY int, Label string, Prior_Forecast double, Current_Forecast double, "
                                    "QoQ double, DataAsOf string")
    flagged = {r.CY for r in views.view6_max_year_flag(outlook).where("Flag = 1").collect()}
    assert flagged == {max(years)}
