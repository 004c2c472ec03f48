"""Session helpers.

The library never creates a session behind the caller's back; these helpers
exist for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Settings for a large cluster run (~100 TB of input, ~1000 executors). Shuffle
# partition counts are left to AQE: start high, coalesce to ~256 MB partitions,
# split skewed partitions of joins; scans split files at 256 MB.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method of more bytes: generated code beyond that would be interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> None:
    """Apply ``CLUSTER_CONF`` (runtime-settable SQL settings only)."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)


def wide_rows_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings in which plans over wide rows stay compiled.

    Joins and projections of some 60 columns become generated methods of more than 8000
    bytes, which HotSpot interprets. With the limit set to that size Spark runs such a
    part without whole-stage code, in small methods. The caller's session keeps its own.
    """
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set("spark.sql.codegen.hugeMethodLimit", CLUSTER_CONF["spark.sql.codegen.hugeMethodLimit"])
    return other


def build_session(master: str | None = None, app: str = "wharf",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local session tuned like a cluster job: AQE on, skew-join on, UTC."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    cores = master[master.find("[") + 1:-1] if "[" in master else "8"
    parts = shuffle_partitions or (int(cores) if cores.isdigit() else 8)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WHARF_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for scratch tables.

    ``spark.checkpoint.dir`` of the session if set, else the context's
    checkpoint folder, else a folder inside the warehouse. On a cluster a
    warehouse in a local folder is refused: it is not shared. Never a
    machine-local temporary folder, and no setting of the caller is changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"the warehouse {warehouse} is a local folder: set spark.checkpoint.dir to a shared one")
        root = f"{warehouse.rstrip('/')}/_scratch"
    return root.rstrip("/")


def materialize(df, name: str = "table", compression: str = "snappy"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but as a columnar table written in one
    pass (RDD checkpointing serializes rows and recomputes the plan). The
    folder is the session's shared one (``shared_folder``), so every executor
    can read it. The table is
    scratch for this session: it is deleted when the session's file system
    closes (driver exit), so repeated runs do not pile up.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def materialize_parts(parts: Iterable[DataFrame], name: str = "table") -> DataFrame:
    """``materialize`` for rows made in parts, one after the other."""
    parts = list(parts)
    path = scratch_path(parts[0].sparkSession, name)
    write_parts(parts, path)
    return parts[0].sparkSession.read.parquet(path)


def write_parts(parts: Iterable[DataFrame], path: str) -> None:
    """Write one table part by part: at any time there are shuffle files of one part only."""
    mode = "errorifexists"
    for part in parts:
        with shuffles_freed(part.sparkSession):
            part.write.mode(mode).option("compression", "zstd").parquet(path)
        mode = "append"


@contextmanager
def written(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """``df`` as a scratch table that is deleted when the block ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write_parts([df], path)
    try:
        yield spark.read.parquet(path)
    finally:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files go when the query ends, not when the driver's
    garbage collector comes by. For tables written one after the other; the setting is put back."""
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the session."""
    path = f"{shared_folder(spark)}/wharf-tables/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Scratch of this session: deleted when its file system closes."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
