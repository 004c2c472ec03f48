"""Layers: stage -> snapshot append, shard union, table rebuild, run audit
(S-04..S-09).

Shards of the reference (one table per system, suffix = ParentSystemId) are
one dataset partitioned by ParentSystemId here; a shard is a partition and
reading one system is partition pruning.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.functions.casts import wall_datetime
from wharf.operators.upsert import Audit

LINEAGE = ("FileLoadAuditId", "LineNum", "FileEffectiveDate")


def stage_to_snapshot(stage: DataFrame, business_cols: Sequence[str],
                      audit: Audit | None = None,
                      snapshot_from: str | None = "StartInterval",
                      carry_rejects: bool = True) -> DataFrame:
    """S-04 snapshot rows from a validated stage.

    Copies business columns, derives SnapshotRowDateTime (wall time of
    ``snapshot_from``; NULL when it does not parse; omitted when None, as for
    LoginDaily), keeps Load*, stamps Create*/Update*, resets Inactive*.
    Rejected rows are carried and reset to active, as the reference does;
    ``carry_rejects=False`` leaves them out.
    """
    audit = audit or Audit()
    df = stage if carry_rejects else stage.where(~F.coalesce(F.col("InactiveInd"), F.lit(False)))
    cols: list[Column] = [F.col("ParentSystemId"), F.col("SystemId")]
    cols += [F.col(c) for c in business_cols]
    if snapshot_from is not None:
        cols.append(wall_datetime(F.col(snapshot_from)).alias("SnapshotRowDateTime"))
    cols += [F.col(c) for c in ("LoadBy", "LoadDate", "LoadProcess")]
    cols += [v.alias(k) for k, v in audit.stamps().items()]
    cols += [F.col(c) for c in LINEAGE]
    cols += [F.lit(False).alias("InactiveInd"),
             F.lit(None).cast("timestamp").alias("InactiveDate"),
             F.lit("").alias("InactiveReason")]
    return df.select(*cols)


def append_snapshot(snapshot_rows: DataFrame, path: str) -> None:
    """S-04 write: append-only history partitioned by system."""
    snapshot_rows.write.mode("append").partitionBy("ParentSystemId").parquet(path)


def read_shards(spark: SparkSession, path: str, parent_ids: Iterable[int] | None = None) -> DataFrame:
    """S-05 wildcard read of all shards; ``parent_ids`` prunes partitions."""
    df = spark.read.parquet(path)
    if parent_ids is not None:
        df = df.where(F.col("ParentSystemId").isin(list(parent_ids)))
    return df


def union_shards(frames: Sequence[DataFrame]) -> DataFrame:
    """S-05 union of separately held shards; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds data (files or partitions); other errors are raised."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and any(st.getPath().getName()[0] not in "_." for st in fs.listStatus(p))


def rebuild_table(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: Sequence[str] = ()) -> str:
    """S-06/S-07 CTAS: write to a fresh sibling path, then swap it in.

    Never overwrites a path that ``df`` may be reading from. Returns ``path``.
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.__new_{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(fresh)
    fs, target = _fs(spark, path)
    _, fresh_p = _fs(spark, fresh)
    _swap(fs, fresh_p, target, _fs(spark, f"{path.rstrip('/')}.__old_{uuid.uuid4().hex}")[1])
    return path


def _move(fs, src, dest) -> None:
    """Rename, or an error: a file system may refuse by returning false."""
    if not fs.rename(src, dest):
        raise OSError(f"could not move {src} to {dest}")


def _swap(fs, fresh, target, aside) -> None:
    """Put ``fresh`` in the place of ``target``: move aside, move in, then delete.

    A failed second move puts the old folder back; a crash between the moves
    leaves it whole under ``aside``. Nothing is deleted before its replacement
    is in place.
    """
    had = fs.exists(target)
    if had:
        _move(fs, target, aside)
    try:
        _move(fs, fresh, target)
    except Exception:
        if had:
            _move(fs, aside, target)
        raise
    if had:
        fs.delete(aside, True)


def run_audit(summary: DataFrame, run_id: int, job: str, scheduled_at: Column | None = None,
              now: Column | None = None) -> DataFrame:
    """S-09 one audit row per (run, feed, system) from V-05 summaries.

    ``summary`` is ``validate.summarize`` output (grouped by system). The row
    records the run, its window of data and rejected count.
    """
    now = F.current_timestamp() if now is None else now
    return summary.select(
        F.lit(run_id).cast("bigint").alias("RunId"),
        F.lit(job).alias("JobName"),
        (scheduled_at if scheduled_at is not None else now).alias("ScheduledStartDate"),
        "*",
        now.alias("LastCompletedDate"),
        F.when(F.col("rejected") > 0, F.concat(F.col("rejected").cast("string"), F.lit(" rows rejected")))
         .otherwise(F.lit("")).alias("InactiveReason"),
    )


def run_started(spark: SparkSession, run_id: int, job: str, systems: Sequence[tuple[int, int]],
                scheduled_at: Column | None = None, now: Column | None = None) -> DataFrame:
    """S-09 the rows that open a run: one per (ParentSystemId, SystemId), not completed."""
    now = F.current_timestamp() if now is None else now
    return spark.createDataFrame(list(systems), "ParentSystemId bigint, SystemId bigint").select(
        F.lit(run_id).cast("bigint").alias("RunId"), F.lit(job).alias("JobName"),
        (scheduled_at if scheduled_at is not None else now).alias("ScheduledStartDate"),
        "ParentSystemId", "SystemId", F.lit(None).cast("timestamp").alias("LastCompletedDate"),
        F.lit(None).cast("string").alias("InactiveReason"))


def run_finished(started: DataFrame, summary: DataFrame | None = None, failure: str | None = None,
                 now: Column | None = None) -> DataFrame:
    """S-09 the same rows at the end of the run.

    On success every system is completed, with the number of rejected rows of its V-05
    ``summary`` as the reason (a system without rows has none); with ``failure`` the
    rows stay uncompleted and carry its text.
    """
    if failure is not None:
        return started.withColumn("InactiveReason", F.lit(failure))
    now = F.current_timestamp() if now is None else now
    done = started.drop("InactiveReason").withColumn("LastCompletedDate", now.cast("timestamp"))
    if summary is None:
        return done.withColumn("InactiveReason", F.lit(""))
    keys = ["ParentSystemId", "SystemId"]
    n = F.coalesce(F.col("rejected"), F.lit(0))
    reason = F.when(n > 0, F.concat(n.cast("string"), F.lit(" rows rejected"))).otherwise(F.lit(""))
    return done.join(summary.select(*keys, "rejected"), keys, "left").select(
        "RunId", "JobName", "ScheduledStartDate", *keys, "LastCompletedDate", reason.alias("InactiveReason"))


def replace_partitions(df: DataFrame, path: str, partition_cols: Sequence[str]) -> list[str]:
    """Write ``df`` partitioned to a fresh folder, then move each written
    partition folder into ``path``, replacing the folder it supersedes.

    Partitions absent from ``df`` are untouched. Each move is a checked rename
    (metadata only): the old folder is moved aside and deleted only when the new
    one is in place. The set of moves is not atomic as a whole; after a crash,
    folders moved aside lie next to ``path``. Returns the partition folders
    replaced (relative paths).
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.__parts_{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*partition_cols).parquet(fresh)
    fs, root = _fs(spark, fresh)
    _, target_root = _fs(spark, path)
    jvm = spark.sparkContext._jvm

    def leaves(p, rel, depth):
        if depth == len(partition_cols):
            return [(p, rel)]
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if st.isDirectory() and "=" in name:
                out += leaves(st.getPath(), f"{rel}/{name}" if rel else name, depth + 1)
        return out

    moved = []
    for leaf, rel in leaves(root, "", 0):
        dest = jvm.org.apache.hadoop.fs.Path(target_root, rel)
        fs.mkdirs(dest.getParent())
        aside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.__old_{uuid.uuid4().hex}")
        _swap(fs, leaf, dest, aside)
        moved.append(rel)
    fs.delete(root, True)
    return moved
