"""Registered whole-table queries for the seven reference feed specs (M-14, F-01).

``M-14_<feed>_feed`` is a second run of a feed: lines with an odd line number are the
history loaded before (snapshot and a non-empty ODS with legacy stamps, older
measures and some inactive rows), the others are the new delivery; stage, validation,
snapshot, latest per key over all of the history, typing and merge follow, so
rows are updated, inserted beside inactive ones, and inserted again for NULL keys.
``F-01_<feed>_asof`` runs the feed's two table functions, one as a DataFrame and
one in SQL. All of ``lineitem`` is read.

The oracles state key lists, casts, intervals and update lists on their own, read
from the reference's merges, not from the feed specs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.functions.casts import format_wall
from wharf.operators.history import advance_latest
from wharf.plans import feeds
from wharf.plans.feeds import FEEDS, FeedSpec
from wharf.plans.testdata import dec2, fixed_audit, iso, table
from wharf.session import materialize_parts, scratch_path, wide_rows_session

_NAME_COLS = ("AgentFirstName", "AgentLastName", "FirstName", "LastName", "Login")


def _numeric_cols(spec: FeedSpec) -> list[str]:
    return [c for c, t in spec.types.items() if t in ("numeric", "percent")]


def feed_stage(lineitem: DataFrame, spec: FeedSpec, plain: bool = False) -> DataFrame:
    """Lineitem as a stage of ``spec``: one row per line, every business column a string.

    ``plain``: without '%' and with NULL for unparsable intervals, as the plain strict
    casts of the table functions need it.
    """
    k = F.col("l_orderkey")
    start_ts = F.timestamp_add("MINUTE", (k % 48) * 30, F.col("l_shipdate"))
    offset = F.when(F.col("l_returnflag") == "A", F.lit("-05:00")).otherwise(F.lit("Z"))
    qty = dec2(F.col("l_quantity"))
    numeric = _numeric_cols(spec)
    values: dict[str, Column] = {
        "Cosa": F.col("l_returnflag"), "Company": F.col("l_linestatus"),
        "Agent": F.when(k % 101 != 0, F.col("l_suppkey").cast("string")),
        "RoutingProfile": F.concat(F.lit("RP"), F.col("l_linenumber").cast("string")),
        "Queue": F.when(F.col("l_partkey") % 11 == 0, F.lit("  "))
                  .otherwise(F.concat(F.lit(" Q"), (F.col("l_partkey") % 5).cast("string"), F.lit(" "))),
        "StartInterval": F.when(k % 89 == 0, F.lit("n/a") if spec.safe_intervals and not plain else F.lit(None).cast("string"))
                          .otherwise(F.concat(F.substring(iso(start_ts, ""), 1, 19), offset)),
        "EndInterval": F.concat(F.substring(iso(F.timestamp_add("MINUTE", F.lit(30), start_ts), ""), 1, 19),
                                offset),
        "Logout": F.when(k % 83 == 0, F.lit(None).cast("string"))
                   .otherwise(format_wall(F.timestamp_add("HOUR", k % 24, F.col("l_shipdate")),
                                          "MMM d, yyyy h:mm:ss a")),
    }
    for c in _NAME_COLS:
        values[c] = F.concat(F.lit(c[0]), F.col("l_partkey").cast("string"))
    for i, c in enumerate(numeric):
        text = (qty * (i + 1)).cast("string")
        if spec.types[c] == "percent" and not plain:
            text = F.when(k % 3 == 0, F.concat(text, F.lit("%"))).otherwise(text)
        values[c] = text
    if numeric:
        values[numeric[0]] = F.when(k % 97 != 0, values[numeric[0]])
    if "OnlineTime" in spec.columns:
        values["OnlineTime"] = F.floor(F.col("l_extendedprice") / 50).cast("string")
    for j, c in enumerate(c for c, t in spec.types.items() if t in ("int", "int_float")):
        values[c] = F.concat(((F.col("l_suppkey") + j) % 10).cast("string"), F.lit(".5"))
    parent = F.when(F.col("l_linestatus") == "O", F.lit(3462)).otherwise(F.lit(3463))
    # As in ``validate``: a lambda that changes nothing keeps this wide projection out of whole-stage code.
    name = next(c for c in spec.columns if c in ("AgentLastName", "LastName", "RoutingProfile"))
    values[name] = F.element_at(F.transform(F.array(values[name]), lambda v: v), 1)
    return lineitem.select(
        parent.cast("bigint").alias("ParentSystemId"), (parent + 2).cast("bigint").alias("SystemId"),
        *[values[c].alias(c) for c in spec.columns],
        F.col("l_partkey").alias("FileLoadAuditId"),
        (k * 8 + F.col("l_linenumber")).alias("LineNum"),
        F.col("l_shipdate").alias("FileEffectiveDate"),
        F.lit("loader").alias("LoadBy"),
        F.timestamp_add("DAY", F.col("l_partkey") % 10, F.col("l_shipdate")).alias("LoadDate"),
        F.lit("testdata").alias("LoadProcess"),
        F.lit(False).alias("InactiveInd"), F.lit(None).cast("timestamp_ntz").alias("InactiveDate"),
        F.lit(None).cast("string").alias("InactiveReason"))


def legacy_ods(source: DataFrame, spec: FeedSpec) -> DataFrame:
    """The ODS as an earlier run left it: legacy stamps, the first measure one lower, UTC
    columns a day off, and the rows of routing profile RP3 inactive."""
    first = _numeric_cols(spec)[0]
    old = F.lit("2023-01-01").cast("timestamp_ntz")
    closed = F.col("RoutingProfile") == "RP3"
    cols = {first: (F.col(first) - 1).cast("decimal(38,9)"), "LoadBy": F.lit("legacy"), "LoadDate": old,
            "LoadProcess": F.lit("legacy"), "InactiveInd": closed,
            "InactiveReason": F.when(closed, F.lit("closed")).otherwise(F.lit("")),
            "InactiveDate": F.when(closed, old)}
    for who in ("Create", "Update"):
        cols |= {f"{who}By": F.lit("legacy"), f"{who}Date": old, f"{who}Process": F.lit("legacy")}
    if spec.utc_columns:
        cols |= {f"Utc{n}": F.timestamp_add("DAY", F.lit(-1), F.col(f"Utc{n}")) for n in spec.intervals}
    # A measure that is part of the merge key stays as it is.
    if first in spec.merge_keys:
        del cols[first]
    return source.withColumns(cols)


def run_feed_query(spark: SparkSession, sf: str, spec: FeedSpec) -> DataFrame:
    spark, audit = wide_rows_session(spark), fixed_audit()
    lines = table(spark, sf, "lineitem")
    earlier = F.col("l_linenumber") % 2 == 1
    history = feeds.snapshot_rows(feed_stage(lines.where(earlier), spec), spec, audit)
    # The stored ODS is a table: a merge in slices reads it once per slice.
    target = materialize_parts([legacy_ods(feeds.ods_source(history, spec, audit), spec)], f"{spec.name}_target")
    delivery = feed_stage(lines.where(~earlier), spec)
    return feeds.run_feed(delivery, target, spec, audit, history=history)["ods"].drop("InactiveDate")


def run_on_tables_query(spark: SparkSession, sf: str, spec: FeedSpec) -> DataFrame:
    """The same second run on kept tables: the latest rows and the ODS of the first run are
    published, then the delivery is run twice under one batch (the repeat changes nothing)."""
    spark, audit = wide_rows_session(spark), fixed_audit()
    lines = table(spark, sf, "lineitem")
    earlier = F.col("l_linenumber") % 2 == 1
    latest = feeds.latest_table(spark, scratch_path(spark, f"latest-{spec.name}"), spec)
    ods = feeds.ods_table(spark, scratch_path(spark, f"ods-{spec.name}"), spec)
    history = feeds.snapshot_rows(feed_stage(lines.where(earlier), spec), spec, audit)
    first = advance_latest(latest, feeds.ods_eligible(history, spec), feeds.dedup_columns(spec),
                           feeds.ODS_ORDER, feeds.ODS_TIEBREAK, ("runs", 0), feeds.slice_columns(spec))
    ods.publish(legacy_ods(feeds.ods_typed(first, spec, audit), spec), None, ("runs", 0))
    delivery = feed_stage(lines.where(~earlier), spec)
    for _ in range(2):
        feeds.run_feed_on_tables(delivery, ods, latest, spec, ("runs", 1), audit, vacuum=True)
    return ods.read().drop("InactiveDate")


def run_history_query(spark: SparkSession, sf: str, spec: FeedSpec) -> DataFrame:
    """F-01 read from validity intervals, after two runs (lines of odd numbers came late)."""
    spark = wide_rows_session(spark)
    snapshot = feeds.snapshot_rows(feed_stage(table(spark, sf, "lineitem"), spec, plain=True), spec, fixed_audit())
    history = feeds.history_table(spark, scratch_path(spark, f"history-{spec.name}"))
    for batch, part in enumerate((F.col("LineNum") % 2 == 0, F.col("LineNum") % 2 == 1)):
        feeds.record_snapshot(history, snapshot.where(part), spec, ("runs", batch))
        history.vacuum()
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (ASOF_FROM, ASOF_TO))
    one, two = (feeds.history_asof(history, spec, parent, lo, hi) for parent, _ in feeds.SYSTEMS)
    return one.unionByName(two)


ASOF_FROM, ASOF_TO = "1994-01-01 00:00:00", "1997-12-31 23:30:00"


def run_asof_query(spark: SparkSession, sf: str, spec: FeedSpec) -> DataFrame:
    snapshot = feeds.snapshot_rows(feed_stage(table(spark, sf, "lineitem"), spec, plain=True), spec, fixed_audit())
    (one, _), (two, _) = feeds.SYSTEMS
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (ASOF_FROM, ASOF_TO))
    name = feeds.register_asof_function(spark, f"ft_{spec.name}FileSnapshot_{two}", snapshot, spec, two)
    in_sql = spark.sql(f"SELECT * FROM {name}(TIMESTAMP_NTZ'{ASOF_FROM}', TIMESTAMP_NTZ'{ASOF_TO}')")
    return feeds.feed_asof(snapshot, spec, one, lo, hi).unionByName(in_sql)


# --------------------------------------------------------------------------- oracle text

def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_UTC = "make_timestamp(epoch_us(TRY_CAST({c} AS TIMESTAMPTZ)))"
_WALL = "CASE WHEN length(substr({c}, 1, 19)) = 19 THEN TRY_CAST(substr({c}, 1, 19) AS TIMESTAMP) END"
_NOW = "TIMESTAMP '2024-06-30 00:00:00'"


def _stage_sql(spec: FeedSpec, plain: bool = False) -> str:
    qty = "CAST(l_quantity AS DECIMAL(18,2))"
    start_ts = "(l_shipdate + to_minutes(CAST((l_orderkey % 48) * 30 AS BIGINT)))"
    off = "CASE WHEN l_returnflag = 'A' THEN '-05:00' ELSE 'Z' END"
    numeric = _numeric_cols(spec)
    cols = {
        "Cosa": "l_returnflag", "Company": "l_linestatus", "Agent": "CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_suppkey AS VARCHAR) END",
        "RoutingProfile": "'RP' || CAST(l_linenumber AS VARCHAR)",
        "Queue": "CASE WHEN l_partkey % 11 = 0 THEN '  ' ELSE ' Q' || CAST(l_partkey % 5 AS VARCHAR) || ' ' END",
        "StartInterval": f"CASE WHEN l_orderkey % 89 = 0 THEN {_q('n/a') if spec.safe_intervals and not plain else 'NULL'} ELSE strftime({start_ts}, '%Y-%m-%dT%H:%M:%S') || {off} END",
        "EndInterval": f"strftime({start_ts} + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S') || {off}",
        "Logout": "CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE strftime(l_shipdate + to_hours(CAST(l_orderkey % 24 AS BIGINT)), '%b %-d, %Y %-I:%M:%S %p') END",
    }
    for c in _NAME_COLS:
        cols[c] = f"'{c[0]}' || CAST(l_partkey AS VARCHAR)"
    for i, c in enumerate(numeric):
        text = f"CAST({qty} * {i + 1} AS VARCHAR)"
        if spec.types[c] == "percent" and not plain:
            text = f"CASE WHEN l_orderkey % 3 = 0 THEN {text} || '%' ELSE {text} END"
        cols[c] = text
    if numeric:
        cols[numeric[0]] = f"CASE WHEN l_orderkey % 97 <> 0 THEN {cols[numeric[0]]} END"
    if "OnlineTime" in spec.columns:
        cols["OnlineTime"] = "CAST(CAST(floor(l_extendedprice / 50) AS BIGINT) AS VARCHAR)"
    for j, c in enumerate(c for c, t in spec.types.items() if t in ("int", "int_float")):
        cols[c] = f"CAST((l_suppkey + {j}) % 10 AS VARCHAR) || '.5'"
    body = ",\n         ".join(f"{cols[c]} AS {c}" for c in spec.columns)
    return f"""
  SELECT CAST(CASE WHEN l_linestatus = 'O' THEN 3462 ELSE 3463 END AS BIGINT) AS ParentSystemId,
         CAST(CASE WHEN l_linestatus = 'O' THEN 3464 ELSE 3465 END AS BIGINT) AS SystemId,
         {body},
         l_partkey AS FileLoadAuditId, l_shipdate AS FileEffectiveDate, l_orderkey * 8 + l_linenumber AS LineNum,
         'loader' AS LoadBy, l_shipdate + to_days(CAST(l_partkey % 10 AS INTEGER)) AS LoadDate,
         l_linenumber % 2 = 1 AS earlier
  FROM lineitem"""


# Of each merge of the reference, the window's keys, the match keys, how
# intervals are read (wall clock or UTC), whether rows without parsable intervals
# are left out, how counts are rounded, which measures lose their '%', whether the
# snapshot's load stamp is kept, and the columns that an update leaves alone.
_AGENT = "Cosa, Company, Agent, RoutingProfile, StartInterval, EndInterval"
_AGENT_QUEUE = "Cosa, Company, Agent, RoutingProfile, Queue, StartInterval, EndInterval"
_ROUTING = "Cosa, Company, Queue, RoutingProfile, StartInterval, EndInterval"
_LEVELS = "ServiceLevel30Seconds, ServiceLevel60Seconds"
_MERGES = {
    "AgentDaily": dict(window=_AGENT, match=_AGENT, read="wall", parsable=False, counts="double",
                       percent="", own_load=True, kept=""),
    "AgentInterval": dict(window=_AGENT, match=_AGENT, read="utc", parsable=True, counts="double",
                          percent="", own_load=True, kept="UtcStartInterval, UtcEndInterval", window_utc=True),
    "AgentQueueDaily": dict(window=_AGENT_QUEUE, match=_AGENT_QUEUE, read="wall", parsable=False, counts="decimal",
                            percent="", own_load=False, kept=""),
    "AgentQueueInterval": dict(window=_AGENT_QUEUE, match=_AGENT_QUEUE, read="wall", parsable=True, counts="decimal",
                               percent="", own_load=False, kept=""),
    "LoginDaily": dict(window="Cosa, Company, RoutingProfile, Duration",
                       match="Cosa, Company, Agent, RoutingProfile, Duration", read="", parsable=False,
                       counts="decimal", percent="", own_load=False, kept=""),
    "QueueRoutingDaily": dict(window=_ROUTING, match=_ROUTING, read="wall", parsable=False, counts="decimal",
                              percent="AgentAnswerRate, " + _LEVELS, own_load=False, kept=""),
    "QueueRoutingInterval": dict(window=_ROUTING, match=_ROUTING, read="utc", parsable=False, counts="decimal",
                                 percent=_LEVELS, own_load=False, kept=""),
}
# The counts among the measures; text columns; the rest are amounts.
_COUNTS = ("ContactsAgentHungUpFirst", "ContactsHandled", "ContactsTransferredOut", "ContactsMissed",
           "ContactsAbandonedIn15Seconds", "ContactsAnsweredIn30Seconds", "ContactsAnsweredIn60Seconds",
           "ContactsAbandoned", "ContactsQueued", "ContactsTransferredIn")
_TEXTS = ("Cosa", "Company", "Agent", "RoutingProfile", "Queue", *_NAME_COLS)
# The keys of the table functions.
_ASOF_KEYS = {"AgentDaily": _AGENT, "AgentInterval": _AGENT, "AgentQueueDaily": _AGENT_QUEUE,
              "AgentQueueInterval": _AGENT_QUEUE, "QueueRoutingDaily": _ROUTING, "QueueRoutingInterval": _ROUTING}


def _names(text: str) -> list[str]:
    return [n.strip() for n in text.split(",") if n.strip()]


def _cast_sql(c: str, read: str, counts: str, percent: list[str]) -> str:
    if c in ("StartInterval", "EndInterval"):
        return (_UTC if read == "utc" else _WALL).format(c=c)
    if c in _TEXTS:
        return c
    if c == "Logout":
        return f"strftime(try_strptime({c}, '%b %d, %Y %I:%M:%S %p'), '%m/%d/%Y %I:%M:%S %p')"
    if c in _COUNTS:
        return f"CAST(ROUND(CAST({c} AS {'DOUBLE' if counts == 'double' else 'DECIMAL(38,9)'})) AS BIGINT)"
    return f"CAST({f'replace({c}, {_q(chr(37))}, {_q(str())})' if c in percent else c} AS DECIMAL(38,9))"


def feed_oracle_sql(spec: FeedSpec, won: str = "TRUE") -> str:
    """``won``: which of the latest rows are merged."""
    m = _MERGES[spec.name]
    match = ["ParentSystemId", "SystemId", *_names(m["match"])]
    window = ["ParentSystemId", "SystemId", *(_UTC.format(c=k) if m.get("window_utc") and k.endswith("Interval") else k
                                              for k in _names(m["window"]))]
    parsable = (" AND ".join(_WALL.format(c=c) + " IS NOT NULL" for c in ("StartInterval", "EndInterval"))
                if m["parsable"] else "TRUE")
    typed = ["COALESCE(NULLIF(trim(Queue), ''), '') AS Queue" if c == "Queue"
             else f"{_cast_sql(c, m['read'], m['counts'], _names(m['percent']))} AS {c}" for c in spec.columns]
    utc = ["UtcStartInterval", "UtcEndInterval"] if m["read"] else []
    typed += [f"{_UTC.format(c=u[3:])} AS {u}" for u in utc]
    load = "LoadBy, LoadDate" if m["own_load"] else f"'wharf' AS LoadBy, {_NOW} AS LoadDate"

    def latest(where: str) -> str:
        return f"""SELECT ParentSystemId, SystemId, {", ".join(typed)}, {load}, 'wharf.testdata' AS LoadProcess, earlier
  FROM stage WHERE {parsable} AND {where}
  QUALIFY row_number() OVER (
    PARTITION BY {", ".join(window)}
    ORDER BY LoadDate DESC NULLS LAST, FileEffectiveDate DESC NULLS LAST, FileLoadAuditId DESC NULLS LAST, LineNum DESC NULLS LAST) = 1"""

    measure = next(c for c in spec.columns if c not in _TEXTS and c not in _COUNTS
                   and c not in ("StartInterval", "EndInterval", "Logout"))
    older = [f"{u} - INTERVAL 1 DAY AS {u}" for u in utc]
    if measure not in match:
        older.append(f"CAST({measure} - 1 AS DECIMAL(38,9)) AS {measure}")
    then = "TIMESTAMP '2023-01-01 00:00:00'"
    older += ["'legacy' AS LoadBy", f"{then} AS LoadDate", "'legacy' AS LoadProcess"]
    stamps = ["CreateBy", "CreateDate", "CreateProcess", "UpdateBy", "UpdateDate", "UpdateProcess"]
    new = dict(zip(stamps, ["'wharf'", _NOW, "'wharf.testdata'"] * 2))
    old = dict(zip(stamps, ["'legacy'", then, "'legacy'"] * 2))
    biz = ["ParentSystemId", "SystemId", *spec.columns, *utc, "LoadBy", "LoadDate", "LoadProcess"]
    on = " AND ".join(f"t.{k} = s.{k}" for k in match) + " AND NOT t.InactiveInd"
    kept = _names(m["kept"])
    merged = [f"t.{c}" if c in kept else f"CASE WHEN s.hit THEN s.{c} ELSE t.{c} END AS {c}" for c in biz]
    merged += [f"CASE WHEN s.hit THEN {new[c]} ELSE t.{c} END AS {c}" for c in stamps]
    return f"""
WITH stage AS ({_stage_sql(spec)}),
s AS (SELECT *, TRUE AS hit FROM ({latest("TRUE")}) WHERE {won}),
t AS (SELECT * REPLACE ({", ".join(older)}), {", ".join(f"{v} AS {c}" for c, v in old.items())},
             COALESCE(RoutingProfile = 'RP3', FALSE) AS InactiveInd,
             CASE WHEN RoutingProfile = 'RP3' THEN 'closed' ELSE '' END AS InactiveReason
      FROM ({latest("earlier")}))
SELECT {", ".join(merged)}, t.InactiveInd, t.InactiveReason FROM t LEFT JOIN s ON {on}
UNION ALL
SELECT {", ".join(f"s.{c}" for c in biz)}, {", ".join(f"{new[c]} AS {c}" for c in stamps)}, FALSE, ''
FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE {on})
"""


def asof_oracle_sql(spec: FeedSpec) -> str:
    cols = [f"{_cast_sql(c, 'wall', 'decimal', [])} AS {c}" for c in spec.columns]
    utc = [f"{_UTC.format(c=c)} AS Utc{c}" for c in ("StartInterval", "EndInterval")]
    wall = _WALL.format(c="StartInterval")
    return f"""
WITH stage AS ({_stage_sql(spec, plain=True)})
SELECT ParentSystemId, SystemId, {", ".join(cols + utc)}, FileEffectiveDate, FileLoadAuditId, FALSE AS InactiveInd
FROM stage WHERE {wall} BETWEEN TIMESTAMP '{ASOF_FROM}' AND TIMESTAMP '{ASOF_TO}'
QUALIFY row_number() OVER (PARTITION BY ParentSystemId, {_ASOF_KEYS[spec.name]}
                           ORDER BY FileEffectiveDate DESC, FileLoadAuditId DESC, LineNum DESC) = 1
"""


def _query(run, spec: FeedSpec):
    return lambda spark, sf: run(spark, sf, spec)


QUERIES = {f"M-14_{name}_feed": _query(run_feed_query, spec) for name, spec in FEEDS.items()}
ORACLES = {f"M-14_{name}_feed": feed_oracle_sql(spec) for name, spec in FEEDS.items()}
# On kept tables only the keys whose latest row was delivered are merged.
ON_TABLES = ("AgentDaily", "AgentInterval", "LoginDaily")
QUERIES |= {f"M-14_{name}_on_tables": _query(run_on_tables_query, FEEDS[name]) for name in ON_TABLES}
ORACLES |= {f"M-14_{name}_on_tables": feed_oracle_sql(FEEDS[name], "NOT earlier") for name in ON_TABLES}
WITH_HISTORY = ("AgentDaily", "QueueRoutingInterval")
QUERIES |= {f"F-01_{name}_history": _query(run_history_query, FEEDS[name]) for name in WITH_HISTORY}
ORACLES |= {f"F-01_{name}_history": asof_oracle_sql(FEEDS[name]) for name in WITH_HISTORY}
QUERIES |= {f"F-01_{name}_asof": _query(run_asof_query, FEEDS[name]) for name in _ASOF_KEYS}
ORACLES |= {f"F-01_{name}_asof": asof_oracle_sql(FEEDS[name]) for name in _ASOF_KEYS}
