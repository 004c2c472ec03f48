"""Ledger of loaded files (S-01, S-03): a batch run takes each delivered version once.

The listing (name, size, time of change; no contents) is anti-joined with the ledger.
Only files left over are read for their checksum: a file whose content was loaded
before under the same name is noted as touched and not loaded again; one with new
content, such as a month-to-date file that has grown, is a new version and is loaded.
Entries are published after the load, with the run, so a run lost before that is
repeated and a repeated run adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.session import materialize
from wharf.sources.stage import any_mask
from wharf.sources.versions import VersionedTable

IDENTITY = ("file", "size", "modified")
NEW, REDELIVERED, TOUCHED = "new", "redelivered", "touched"


def list_files(spark: SparkSession, path: str, mask: str | Sequence[str] | None = None) -> DataFrame:
    """S-01 file, size and time of change of the delivered files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if mask:
        reader = reader.option("pathGlobFilter", any_mask(mask))
    return reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("size"),
                                    F.col("modificationTime").alias("modified"))


def checksums(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """SHA-256 of the contents of ``files`` (names of one run's new files)."""
    if not files:
        return spark.createDataFrame([], "file string, checksum string")
    return spark.read.format("binaryFile").load(list(files)).select(
        F.col("path").alias("file"), F.sha2("content", 256).alias("checksum"))


class FileLedger:
    """Entries: run_id, file, size, modified, checksum, status, n_rows (NULL where not loaded)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def entries(self) -> DataFrame | None:
        return None if self.table.current() is None else self.table.read()

    def take(self, path: str, mask: str | Sequence[str] | None = None) -> DataFrame:
        """The file versions that no run has seen, with checksum and status (a written table)."""
        listing, known = list_files(self.spark, path, mask), self.entries()
        if known is not None:
            listing = listing.join(known.select(*IDENTITY), list(IDENTITY), "left_anti")
        unseen = materialize(listing, "unseen-files")
        sums = checksums(self.spark, [r["file"] for r in unseen.select("file").collect()])
        found = unseen.join(sums, "file")
        if known is None:
            return materialize(found.withColumn("status", F.lit(NEW)), "taken-files")
        # Only earlier versions of the same names matter; a name has one row of them.
        earlier = known.join(unseen.select("file"), "file", "left_semi").groupBy("file").agg(
            F.collect_set("checksum").alias("seen"))
        status = (F.when(F.col("seen").isNull(), NEW)
                  .when(F.array_contains("seen", F.col("checksum")), TOUCHED).otherwise(REDELIVERED))
        return materialize(found.join(earlier, "file", "left").withColumn("status", status).drop("seen"), "taken-files")

    @staticmethod
    def to_load(taken: DataFrame) -> list[str]:
        """Names of the files to load, for the stage reader."""
        return [r["file"] for r in taken.where(F.col("status") != TOUCHED).select("file").collect()]

    def record(self, taken: DataFrame, counts: DataFrame, run_id: int) -> None:
        """Note a run's files after their load. ``counts``: file, n_rows."""
        if self.table.has_applied("ledger", run_id):
            return
        rows = taken.join(counts.select("file", "n_rows"), "file", "left").select(
            F.lit(run_id).cast("bigint").alias("run_id"), *IDENTITY, "checksum", "status",
            F.when(F.col("status") != TOUCHED, F.coalesce("n_rows", F.lit(0).cast("bigint"))).alias("n_rows"))
        self.table.publish(rows, [], ("ledger", run_id))
