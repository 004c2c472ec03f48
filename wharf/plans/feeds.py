"""Feed specs and the feed pipeline (M-14): stage -> validate -> snapshot ->
latest per key -> typed ODS source -> upsert, plus the F-01 table function.

A feed is data (``FeedSpec``); the seven contact-centre feeds of the reference
are instances. Column names, message labels and key lists below are fixed
values that must equal the reference's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.functions import casts
from wharf.operators.asof import snapshot_asof
from wharf.operators.dedup import latest_per_key
from wharf.operators.history import BATCH, advance_latest, files_between, record_run, valid_at
from wharf.operators.merge_files import merge_into
from wharf.operators.slices import slice_count, take_slice
from wharf.operators.upsert import Audit, upsert
from wharf.operators.validate import AtMost, ObservedSummary, Parses, Required, Rule, summarize, validate
from wharf.session import materialize, materialize_parts
from wharf.sources.layers import replace_partitions, stage_to_snapshot
from wharf.sources.versions import VersionedTable

COMMON = ("Cosa", "Company")

# Ordered from strict (the table function, the MERGE source) to safe forms.
_TYPED = {
    "numeric": casts.to_numeric,
    "int": casts.int_from_numeric,
    "int_float": casts.int_from_float_round,
    "percent": lambda c: casts.percent_numeric(c, safe=False),
    "logout": casts.reformat_us_timestamp,
    "string": lambda c: c,
}


@dataclass(frozen=True)
class FeedSpec:
    name: str
    columns: tuple[str, ...]                 # business columns, all STRING in stage
    types: dict[str, str]                    # ODS typing of non-key columns
    dedup_keys: tuple[str, ...]              # W-01 partition (after system ids)
    merge_keys: tuple[str, ...]              # U-01 match (after system ids)
    rules: tuple[Rule, ...]
    asof_keys: tuple[str, ...] | None = None  # F-01 partition; None: no table function
    intervals: tuple[str, ...] = ("StartInterval", "EndInterval")
    start_mode: str = "wall"                 # ODS StartInterval: wall clock or UTC
    safe_intervals: bool = False             # P-09 drop rows whose intervals do not parse
    dedup_on_utc: bool = False               # W-02 partition on normalised date-times
    normalize_queue: bool = False            # P-05
    load_stamp: str = "now"                  # 'source': keep snapshot LoadBy/LoadDate
    update_exclude: tuple[str, ...] = ()     # U-02
    utc_columns: bool = True
    asof_types: dict[str, str] = field(default_factory=dict)

    @property
    def snapshot_from(self) -> str | None:
        return self.intervals[0] if self.intervals else None


# --------------------------------------------------------------------------- rules

def _interval_rules(names=("StartInterval", "EndInterval")) -> list[Rule]:
    out: list[Rule] = []
    for n in names:
        out += [Required(n), Parses(n, "datetime")]
    return out


def _parse_rules(types: dict[str, str], skip=(), labels: dict[str, str] | None = None) -> list[Rule]:
    labels = labels or {}
    kind = {"numeric": "numeric", "percent": "numeric", "int": "int", "int_float": "int"}
    return [Parses(c, kind[t], labels.get(c)) for c, t in types.items()
            if t in kind and c not in skip]


# --------------------------------------------------------------------------- the seven feeds
# Measure lists of the reference feeds, in stage order.
AGENT_TIMES = (
    "AgentIdleTime", "AgentOnContactTime", "NonproductiveTime", "Occupancy", "OnlineTime",
    "BackOffSptInsSptIntradiemTime", "DevelopmentLabActivitiesTime", "CATClaimsOnlyTime",
    "ComputerITIssuesHelpDeskTime", "PersonalUnscheduledBreakTime", "OutboundCallingTime",
    "MemberSupportTime", "MeetingTime", "CoachingTime", "AfterContactWorkTime",
    "AgentInteractionTime", "AverageAfterContactWorkTime", "AverageAgentInteractionTime",
    "AverageHandleTime", "ContactHandleTime",
)
QUEUE_TIMES = ("AfterContactWorkTime", "AgentInteractionTime", "AverageAfterContactWorkTime",
               "AverageAgentInteractionTime", "AverageHandleTime", "ContactHandleTime")
AGENT_COUNTS = ("ContactsAgentHungUpFirst", "ContactsHandled", "ContactsTransferredOut")
ROUTING_MEASURES = (
    "AgentAnswerRate", "ContactsMissed", "ContactsAbandonedIn15Seconds",
    "ContactsAnsweredIn30Seconds", "ContactsAnsweredIn60Seconds", "ServiceLevel30Seconds",
    "ServiceLevel60Seconds", "AfterContactWorkTime", "AgentInteractionTime",
    "AverageAfterContactWorkTime", "AverageAgentInteractionTime", "AverageHandleTime",
    "AverageQueueAbandonTime", "AverageQueueAnswerTime", "ContactHandleTime", "ContactsAbandoned",
    "ContactsAgentHungUpFirst", "ContactsHandled", "ContactsQueued", "ContactsTransferredIn",
    "ContactsTransferredOut", "MaximumQueuedTime",
)
ROUTING_COUNTS = (
    "ContactsMissed", "ContactsAbandonedIn15Seconds", "ContactsAnsweredIn30Seconds",
    "ContactsAnsweredIn60Seconds", "ContactsAbandoned", "ContactsAgentHungUpFirst",
    "ContactsHandled", "ContactsQueued", "ContactsTransferredIn", "ContactsTransferredOut",
)
ROUTING_PERCENTS = ("AgentAnswerRate", "ServiceLevel30Seconds", "ServiceLevel60Seconds")
# Message labels of the AgentQueueInterval validator (casing and the
# stray tab are the reference's).
AGENT_QUEUE_INTERVAL_LABELS = {
    "Cosa": "CoSA",
    "AfterContactWorkTime": "Aftercontactworktime",
    "AgentInteractionTime": "Agentinteractiontime",
    "AverageAfterContactWorkTime": "Averageaftercontactworktime",
    "AverageAgentInteractionTime": "Averageagentinteractiontime\t",
    "AverageHandleTime": "Averagehandletime",
    "ContactHandleTime": "Contacthandletime",
    "ContactsAgentHungUpFirst": "Contactsagenthungupfirst",
    "ContactsHandled": "Contactshandled",
    "ContactsTransferredOut": "Contactstransferredout",
}


def _types(names, kind) -> dict[str, str]:
    return {n: kind for n in names}


def _agent_feed(name: str, interval: bool) -> FeedSpec:
    types = {"AgentFirstName": "string", "AgentLastName": "string",
             **_types(AGENT_TIMES, "numeric"), **_types(AGENT_COUNTS, "int_float")}
    skip = () if interval else ("NonproductiveTime",)
    rules = [Required("Cosa"), Required("Agent"), Required("RoutingProfile"), *_interval_rules()]
    rules += _parse_rules(types, skip=skip)
    if interval:
        rules.append(AtMost("OnlineTime", 1800, "OnlineTime Invalid Interval Data"))
    return FeedSpec(
        name=name,
        columns=(*COMMON, "Agent", "RoutingProfile", "StartInterval", "EndInterval", *types),
        types=types,
        dedup_keys=(*COMMON, "Agent", "RoutingProfile", "StartInterval", "EndInterval"),
        merge_keys=(*COMMON, "Agent", "RoutingProfile", "StartInterval", "EndInterval"),
        rules=tuple(rules),
        asof_keys=("StartInterval", "EndInterval", *COMMON, "Agent", "RoutingProfile"),
        start_mode="utc" if interval else "wall",
        safe_intervals=interval, dedup_on_utc=interval, load_stamp="source",
        update_exclude=("UtcStartInterval", "UtcEndInterval") if interval else (),
        asof_types={c: "int" for c in AGENT_COUNTS},
    )


def _agent_queue_feed(name: str, interval: bool) -> FeedSpec:
    types = {"AgentFirstName": "string", "AgentLastName": "string",
             **_types(QUEUE_TIMES, "numeric"), **_types(AGENT_COUNTS, "int")}
    labels = AGENT_QUEUE_INTERVAL_LABELS if interval else {}
    rules = [Required("Cosa", labels.get("Cosa")), Required("Agent"), Required("RoutingProfile"),
             *_interval_rules()]
    if not interval:
        rules += [Required("AgentFirstName"), Required("AgentLastName")]
    rules += _parse_rules(types, labels=labels)
    keys = (*COMMON, "Agent", "RoutingProfile", "Queue", "StartInterval", "EndInterval")
    return FeedSpec(
        name=name,
        columns=(*COMMON, "Agent", "RoutingProfile", "Queue", "StartInterval", "EndInterval", *types),
        types=types, dedup_keys=keys, merge_keys=keys, rules=tuple(rules),
        asof_keys=("StartInterval", "EndInterval", *COMMON, "Agent", "RoutingProfile", "Queue"),
        safe_intervals=interval, normalize_queue=True,
    )


def _routing_feed(name: str, interval: bool) -> FeedSpec:
    types = {c: ("int" if c in ROUTING_COUNTS else "percent" if c in ROUTING_PERCENTS else "numeric")
             for c in ROUTING_MEASURES}
    if interval:
        types["AgentAnswerRate"] = "numeric"  # the interval merge does not strip '%'
    rules = [Required("Cosa")] + ([Required("Queue")] if interval else [])
    rules += [Required("RoutingProfile"), *_interval_rules(), *_parse_rules(types)]
    keys = (*COMMON, "Queue", "RoutingProfile", "StartInterval", "EndInterval")
    return FeedSpec(
        name=name,
        columns=(*COMMON, "Queue", "RoutingProfile", "StartInterval", "EndInterval", *ROUTING_MEASURES),
        types=types, dedup_keys=keys, merge_keys=keys, rules=tuple(rules),
        asof_keys=("StartInterval", "EndInterval", *COMMON, "Queue", "RoutingProfile"),
        start_mode="utc" if interval else "wall", normalize_queue=True,
        asof_types={c: "numeric" for c in ROUTING_PERCENTS},  # the table functions cast plainly
    )


LOGIN_DAILY = FeedSpec(
    name="LoginDaily",
    columns=(*COMMON, "Agent", "FirstName", "LastName", "RoutingProfile", "Login", "Logout", "Duration"),
    types={"FirstName": "string", "LastName": "string", "Login": "string",
           "Logout": "logout", "Duration": "numeric"},
    dedup_keys=(*COMMON, "RoutingProfile", "Duration"),          # W-03: no Agent
    merge_keys=(*COMMON, "Agent", "RoutingProfile", "Duration"),
    rules=(Required("Cosa"), Required("Agent"), Required("RoutingProfile"), Required("Login"),
           Parses("Duration", "numeric")),
    asof_keys=None, intervals=(), utc_columns=False,
)

FEEDS: dict[str, FeedSpec] = {
    "AgentDaily": _agent_feed("AgentDaily", interval=False),
    "AgentInterval": _agent_feed("AgentInterval", interval=True),
    "AgentQueueDaily": _agent_queue_feed("AgentQueueDaily", interval=False),
    "AgentQueueInterval": _agent_queue_feed("AgentQueueInterval", interval=True),
    "LoginDaily": LOGIN_DAILY,
    "QueueRoutingDaily": _routing_feed("QueueRoutingDaily", interval=False),
    "QueueRoutingInterval": _routing_feed("QueueRoutingInterval", interval=True),
}

# Fixed value: system pairs (ParentSystemId, SystemId) of the reference config.
SYSTEMS = ((3462, 3464), (3463, 3465))


# --------------------------------------------------------------------------- pipeline

def validate_stage(stage: DataFrame, spec: FeedSpec, now: Column | None = None) -> DataFrame:
    """V-01 for a feed."""
    return validate(stage, spec.rules, now)


def stage_summary(validated: DataFrame, spec: FeedSpec) -> DataFrame:
    """V-05 per system: min/max StartInterval of active rows, rejected count."""
    return summarize(validated, spec.snapshot_from, by=("ParentSystemId", "SystemId"))


def snapshot_rows(validated: DataFrame, spec: FeedSpec, audit: Audit | None = None,
                  carry_rejects: bool = True) -> DataFrame:
    """S-04 for a feed."""
    return stage_to_snapshot(validated, spec.columns, audit, spec.snapshot_from, carry_rejects)


def _interval_value(name: str, mode: str, strict: bool) -> Column:
    c = F.col(name)
    if mode == "utc":
        return casts.utc_datetime(c, safe=False)
    return casts.wall_datetime(c, safe=not strict)


ODS_ORDER = ("LoadDate",)
# Our addition: the reference orders by LoadDate only.
ODS_TIEBREAK = ("CreateDate", "FileEffectiveDate", "FileLoadAuditId", "LineNum")


def ods_eligible(snapshot: DataFrame, spec: FeedSpec) -> DataFrame:
    """The snapshot rows that the ODS reads (P-08, P-09)."""
    df = snapshot.where(F.col("InactiveInd") == F.lit(False))                      # P-08
    if spec.safe_intervals:                                                         # P-09
        for n in spec.intervals:
            df = df.where(casts.wall_datetime(F.col(n)).isNotNull())
    return df


def dedup_columns(spec: FeedSpec) -> list[Column]:
    """W-01..W-03: the columns or expressions whose latest row counts, system ids first."""
    return [F.col("ParentSystemId"), F.col("SystemId"),
            *[casts.utc_datetime(F.col(k)) if spec.dedup_on_utc and k in spec.intervals else F.col(k)
              for k in spec.dedup_keys]]


def ods_source(snapshot: DataFrame, spec: FeedSpec, audit: Audit | None = None,
               tiebreak: Sequence = ODS_TIEBREAK) -> DataFrame:
    """Typed, de-duplicated MERGE source (W-01..W-03, P-05, P-08, P-09, T-*)."""
    latest = latest_per_key(ods_eligible(snapshot, spec), dedup_columns(spec), list(ODS_ORDER), list(tiebreak))
    return ods_typed(latest, spec, audit)


def ods_typed(df: DataFrame, spec: FeedSpec, audit: Audit | None = None) -> DataFrame:
    """The ODS columns of snapshot rows that are the latest of their keys."""
    audit = audit or Audit()
    strict = not spec.safe_intervals
    cols: list[Column] = [F.col("ParentSystemId"), F.col("SystemId")]
    typed_done = set()
    for c in spec.columns:
        if c in spec.intervals:
            cols.append(_interval_value(c, spec.start_mode, strict).alias(c))
        elif c == "Queue" and spec.normalize_queue:
            cols.append(casts.normalize_blank_to_empty(F.col(c)).alias(c))
        elif c in spec.types:
            cols.append(_TYPED[spec.types[c]](F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
        typed_done.add(c)
    if spec.utc_columns:
        for n in spec.intervals:
            cols.append(casts.utc_datetime(F.col(n), safe=False).alias(f"Utc{n}"))
    stamps = audit.stamps()
    if spec.load_stamp == "source":
        cols += [F.col("LoadBy"), F.col("LoadDate")]
    else:
        cols += [stamps["CreateBy"].alias("LoadBy"), stamps["CreateDate"].alias("LoadDate")]
    cols.append(F.lit(audit.process).alias("LoadProcess"))
    return df.select(*cols)


def merge_ods(target: DataFrame, source: DataFrame, spec: FeedSpec, audit: Audit | None = None,
              **kw) -> DataFrame:
    """U-01 for a feed: keys are system ids + the feed's merge keys."""
    return upsert(target, source, ods_keys(spec), ods_updates(source, spec), audit, **kw)


def ods_keys(spec: FeedSpec) -> list[str]:
    return ["ParentSystemId", "SystemId", *spec.merge_keys]


def slice_columns(spec: FeedSpec) -> list[str]:
    """Key columns that latest rows, merge and table function share as they are: no two slices by
    them share a key. The agent alone if it is one, as a pass evaluates them for all rows."""
    same = [k for k in spec.merge_keys if k in spec.dedup_keys and k not in spec.intervals and k not in spec.types
            and not (k == "Queue" and spec.normalize_queue)]
    return ["Agent"] if "Agent" in same else same


def ods_updates(source: DataFrame, spec: FeedSpec) -> list[str]:
    """U-02 the columns that a match overwrites."""
    return [c for c in source.columns if c not in spec.update_exclude]


def ods_table(spark, path: str, spec: FeedSpec) -> VersionedTable:
    """The ODS of a feed as a recoverable table; files are found by their first interval column."""
    return VersionedTable(spark, path, spec.intervals[:1])


def merge_ods_table(table: VersionedTable, source: DataFrame, spec: FeedSpec, audit: Audit | None = None,
                    batch: tuple[str, int] | None = None, stored: bool = False, **kw) -> list[str]:
    """U-01 on a recoverable ODS: only files that can hold a key of ``source`` are read and replaced.

    The first merge, into nothing, publishes the source's rows. Returns the files replaced.
    """
    if table.current() is not None:
        return merge_into(table, source, ods_keys(spec), ods_updates(source, spec), audit, batch, stored,
                          slice_columns(spec), **kw)
    source = materialize(source, f"{spec.name}_source")
    if not source.isEmpty():                                   # the table starts with its first rows
        table.publish(merge_ods(ods_empty(source), source, spec, audit, **kw), None, batch)
    return []


def ods_empty(source: DataFrame) -> DataFrame:
    """An ODS without rows for a typed source."""
    own = {**{f"{who}{what}": t for who in ("Create", "Update")
              for what, t in (("By", "string"), ("Date", "timestamp"), ("Process", "string"))},
           "InactiveInd": "boolean", "InactiveReason": "string", "InactiveDate": "timestamp"}
    return source.limit(0).withColumns({c: F.lit(None).cast(t) for c, t in own.items()})


def asof_projection(spec: FeedSpec) -> list[Column]:
    """F-01 typed select list: wall and UTC intervals, strict casts."""
    cols: list[Column] = [F.col("ParentSystemId"), F.col("SystemId")]
    for c in spec.columns:
        if c in spec.intervals:
            cols.append(casts.wall_datetime(F.col(c), safe=False).alias(c))
        elif c in spec.types:
            kind = spec.asof_types.get(c, spec.types[c])
            kind = "int" if kind == "int_float" else kind
            cols.append(_TYPED[kind](F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    for n in spec.intervals:
        cols.append(casts.utc_datetime(F.col(n), safe=False).alias(f"Utc{n}"))
    return cols + [F.col("FileEffectiveDate"), F.col("FileLoadAuditId"), F.col("InactiveInd")]


def feed_asof(snapshot: DataFrame, spec: FeedSpec, parent_id: int, start, end) -> DataFrame:
    """F-01 ``ft_<feed>FileSnapshot_<system>(start, end)`` for any feed and system."""
    if spec.asof_keys is None:
        raise ValueError(f"{spec.name} has no snapshot table function")
    return snapshot_asof(snapshot, spec.asof_keys, asof_projection(spec), start, end,
                         parent_id=parent_id, tiebreak=["FileLoadAuditId", "LineNum"])


def run_feed(stage: DataFrame, target: DataFrame, spec: FeedSpec, audit: Audit | None = None,
             history: DataFrame | None = None, materialize_stage: bool = True) -> dict[str, DataFrame]:
    """M-14 one run of a feed: the caller decides what to write.

    Returns ``validated`` (stage with flags), ``summary`` (V-05), ``snapshot``
    (new snapshot rows), ``ods`` (new ODS). ``history`` is the existing
    snapshot; the ODS is merged from history + new rows, as the wildcard read
    of the reference does. The validated stage -- a table updated in place in
    the reference -- is written once (``materialize_stage``) so the three
    outputs read it instead of re-running the rules, and later plans start
    from plain columns (keeps Catalyst's constraint inference small). Then also the
    new ODS of a large history is written, slice by slice of the keys: the sorts and the
    merge move every row through the shuffle files several times, far more than it takes
    as a table.
    """
    audit = audit or Audit()
    validated = validate_stage(stage, spec, audit.now)
    if materialize_stage:
        validated = materialize(validated, f"{spec.name}_stage", "zstd")
    snap = snapshot_rows(validated, spec, audit)
    full = snap if history is None else history.unionByName(snap, allowMissingColumns=True)
    by = [F.col(c).cast(full.schema[c].dataType) for c in slice_columns(spec)]
    n = slice_count(full.count()) if materialize_stage else 1
    parts = [merge_ods(take_slice(target, by, i, n), ods_source(take_slice(full, by, i, n), spec, audit), spec, audit)
             for i in range(n)]
    return {"validated": validated, "summary": stage_summary(validated, spec),
            "snapshot": snap, "ods": parts[0] if n == 1 else materialize_parts(parts, f"{spec.name}_ods")}


def latest_table(spark, path: str, spec: FeedSpec) -> VersionedTable:
    """W-01 the table of latest snapshot rows of a feed (``operators.history``)."""
    at = [f"key_{2 + spec.dedup_keys.index(n)}" for n in spec.intervals[:1]]
    return VersionedTable(spark, path, [*at, BATCH])


def run_feed_on_tables(stage: DataFrame, ods: VersionedTable, latest: VersionedTable, spec: FeedSpec,
                       batch: tuple[str, int], audit: Audit | None = None,
                       systems: Sequence[tuple[int, int]] = SYSTEMS, vacuum: bool = False) -> dict[str, DataFrame]:
    """M-14 one run on kept tables: the history is not read, nor files without the delivery's keys.

    The delivery's rows enter the table of latest rows; those that win are merged into
    the ODS. Both tables are published with ``batch``, so a run lost between them can
    be repeated. The summary of ``systems`` comes from the write of the stage. Returns
    ``validated``, ``summary`` and ``snapshot`` as ``run_feed``. A batch that both tables
    hold already is recognised before its stage is written; its outputs are computed when read.
    ``vacuum``: what a publication replaced is deleted after it (nobody may be reading it).
    """
    audit = audit or Audit()
    if ods.has_applied(*batch) and latest.has_applied(*batch):
        validated = validate_stage(stage, spec, audit.now)
        return {"validated": validated, "summary": stage_summary(validated, spec),
                "snapshot": snapshot_rows(validated, spec, audit)}
    seen = ObservedSummary(spec.snapshot_from, ("ParentSystemId", "SystemId"), systems)
    validated = materialize(seen.watch(validate_stage(stage, spec, audit.now)), f"{spec.name}_stage", "zstd")
    snap = snapshot_rows(validated, spec, audit)
    won = advance_latest(latest, ods_eligible(snap, spec), dedup_columns(spec), ODS_ORDER, ODS_TIEBREAK, batch,
                         slice_columns(spec))
    if vacuum:
        latest.vacuum()
    merge_ods_table(ods, ods_typed(won, spec, audit), spec, audit, batch, stored=True)
    if vacuum:
        ods.vacuum()
    return {"validated": validated, "summary": seen.rows(stage.sparkSession), "snapshot": snap}


def history_table(spark, path: str) -> VersionedTable:
    """F-01 the snapshot with validity intervals."""
    return VersionedTable(spark, path, ["SnapshotRowDateTime"])


ASOF_ORDER, ASOF_TIEBREAK = ("FileEffectiveDate", "CreateDate"), ("FileLoadAuditId", "LineNum")


def record_snapshot(table: VersionedTable, snapshot: DataFrame, spec: FeedSpec, batch: tuple[str, int]) -> None:
    """F-01 add a run's active snapshot rows to the history."""
    record_run(table, snapshot.where(~F.col("InactiveInd")), ["ParentSystemId", *spec.asof_keys],
               ASOF_ORDER, ASOF_TIEBREAK, batch, slice_columns(spec))


def history_asof(table: VersionedTable, spec: FeedSpec, parent_id: int, start: Column, end: Column,
                 at: Column | None = None) -> DataFrame:
    """``feed_asof`` from the history: interval and date filters, no window.

    ``at``: the rows as they were known at that time (by FileEffectiveDate).
    """
    rows = table.read(files_between(table, "SnapshotRowDateTime", start, end))
    rows = valid_at(rows, at).where((F.col("ParentSystemId") == F.lit(parent_id))
                                    & F.col("SnapshotRowDateTime").between(start, end))
    return rows.select(*asof_projection(spec))


def register_asof_function(spark, name: str, snapshot: DataFrame, spec: FeedSpec,
                           parent_id: int | None = None) -> str:
    """F-01 as a Spark SQL table function: ``SELECT * FROM name(start, end)``.

    A temporary view holds the snapshot's typed projection (plus the raw key
    strings the window partitions on); the function filters it by the window
    and keeps the latest row per key. Filters on the view's columns are pushed
    below the projection and into the scan by Catalyst.
    """
    if spec.asof_keys is None:
        raise ValueError(f"{spec.name} has no snapshot table function")
    src = snapshot if parent_id is None else snapshot.where(F.col("ParentSystemId") == F.lit(parent_id))
    keys = [f"__k{i}" for i in range(len(spec.asof_keys))]
    view = f"__wharf_{name}_typed"
    src.select(*asof_projection(spec),
               *[F.col(k).alias(a) for k, a in zip(spec.asof_keys, keys)],
               F.col("SnapshotRowDateTime").alias("__snap_dt"), F.col("CreateDate").alias("__created"),
               F.col("LineNum").alias("__line")).createOrReplaceTempView(view)
    hidden = ", ".join([*keys, "__snap_dt", "__created", "__line", "__rn"])
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(iStartDate TIMESTAMP_NTZ, iEndDate TIMESTAMP_NTZ)
        RETURNS TABLE
        RETURN SELECT * EXCEPT ({hidden}) FROM (
          SELECT *, row_number() OVER (
                   PARTITION BY {", ".join(keys)}
                   ORDER BY FileEffectiveDate DESC, __created DESC, FileLoadAuditId DESC, __line DESC) AS __rn
          FROM {view}
          WHERE NOT InactiveInd AND __snap_dt >= iStartDate AND __snap_dt <= iEndDate)
        WHERE __rn = 1""")
    return name


def register_feed_functions(spark, snapshots: dict[str, DataFrame],
                            systems=SYSTEMS) -> list[str]:
    """All table functions: ``ft_<feed>FileSnapshot_<ParentSystemId>`` per feed and system."""
    names = []
    for feed, snap in snapshots.items():
        spec = FEEDS[feed]
        if spec.asof_keys is None:
            continue
        for parent, _ in systems:
            names.append(register_asof_function(spark, f"ft_{feed}FileSnapshot_{parent}", snap, spec, parent))
    return names


# Partition columns of a partitioned ODS: the system and the month of StartInterval.
ODS_PARTITIONS = ("ParentSystemId", "StartMonth")


def ods_partitions(spec: FeedSpec) -> tuple[str, ...]:
    """(ParentSystemId, StartMonth); feeds without intervals: the system only."""
    return ODS_PARTITIONS if spec.intervals else ODS_PARTITIONS[:1]


def with_ods_partition(df: DataFrame, spec: FeedSpec) -> DataFrame:
    """Add ``StartMonth``: the first day of the StartInterval month."""
    if not spec.intervals:
        return df
    return df.withColumn("StartMonth", F.trunc(F.col(spec.intervals[0]), "month"))


def merge_ods_partitions(spark, ods_path: str, source: DataFrame, spec: FeedSpec,
                         audit: Audit | None = None, **kw) -> list[str]:
    """U-01 on a partitioned ODS, rewriting only the partitions the source touches.

    A month-to-date delivery touches one or two (system, month) partitions, so
    a run reads and rewrites those instead of the whole ODS. The source is written
    once; the touched partitions are read off the written rows and matched
    NULL-safely, so a partition without a month keeps its stored rows.
    """
    parts = list(ods_partitions(spec))
    src = materialize(with_ods_partition(source, spec), f"{spec.name}_source")
    touched = src.select(*[F.col(c).alias(f"__{c}") for c in parts]).distinct()
    stored = spark.read.parquet(ods_path)
    same = F.lit(True)
    for c in parts:
        same = same & stored[c].cast(src.schema[c].dataType).eqNullSafe(F.col(f"__{c}"))
    target = stored.join(touched, same, "left_semi")
    merged = merge_ods(target, src, spec, audit, **kw)
    return replace_partitions(materialize(merged, f"{spec.name}_merged"), ods_path, parts)
