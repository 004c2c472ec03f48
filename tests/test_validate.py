from pyspark.sql import functions as F

from wharf.operators.validate import AtMost, Parses, Required, summarize, validate
from wharf.plans.feeds import FEEDS

RULES = [Required("Agent"), Parses("Occupancy", "numeric"), Parses("OnlineTime", "numeric"),
         AtMost("OnlineTime", 1800, "OnlineTime Invalid Interval Data")]


def test_messages_and_flags(spark):
    df = spark.createDataFrame(
        [(1, None, "x", "1800"), (2, "", "1", "1800.4"), (3, "a", "1", "1800.5"), (4, "a", "1", "1801"),
         (5, "a", "1", "zz")],
        "LineNum long, Agent string, Occupancy string, OnlineTime string")
    out = {r.LineNum: r for r in validate(df, RULES, F.current_timestamp()).collect()}
    assert out[1].InactiveInd and out[1].InactiveReason == \
        "Validation failure: Agent missing value, Occupancy parse error"
    assert not out[2].InactiveInd and out[2].InactiveReason is None and out[2].InactiveDate is None
    assert out[3].InactiveReason == "Validation failure: OnlineTime Invalid Interval Data"
    assert out[4].InactiveInd
    assert out[5].InactiveReason == "Validation failure: OnlineTime parse error"


def test_already_inactive_rows_keep_flags(spark):
    df = spark.createDataFrame([(1, "a", "1", "1", True, "old")],
                               "LineNum long, Agent string, Occupancy string, OnlineTime string, "
                               "InactiveInd boolean, InactiveReason string")
    r = validate(df, RULES).collect()[0]
    assert r.InactiveInd and r.InactiveReason == "old"


def test_summary_counts_all_inactive(spark):
    df = spark.createDataFrame(
        [("2024-01-02T00:00:00", False), ("2024-01-05T00:00:00", False), ("2024-01-09T00:00:00", True)],
        "StartInterval string, InactiveInd boolean")
    r = summarize(df, "StartInterval").collect()[0]
    assert str(r.min_date) == "2024-01-02 00:00:00" and str(r.max_date) == "2024-01-05 00:00:00"
    assert r.rejected == 1


def test_feed_rule_sets():
    msgs = lambda f: [r.branch()[1] for r in FEEDS[f].rules]
    assert "NonproductiveTime parse error" not in msgs("AgentDaily")
    assert "NonproductiveTime parse error" in msgs("AgentInterval")
    assert "OnlineTime Invalid Interval Data" in msgs("AgentInterval")
    assert "CoSA missing value" in msgs("AgentQueueInterval")
    assert "Averageagentinteractiontime\t parse error" in msgs("AgentQueueInterval")
    assert "AgentFirstName missing value" in msgs("AgentQueueDaily")
    assert "Queue missing value" in msgs("QueueRoutingInterval")
    assert "Queue missing value" not in msgs("QueueRoutingDaily")
    assert msgs("LoginDaily") == ["Cosa missing value", "Agent missing value", "RoutingProfile missing value",
                                  "Login missing value", "Duration parse error"]
