"""Recoverable publication (S-06, K-01): immutable files, a list of the live ones, a pointer.

A table is a folder with

  data/<run>/part-*.parquet   rows; a run writes a folder of its own, nothing is changed
  lists/<run>                 one parquet table per version: the live files with their row
                              counts and the ranges of chosen columns
  versions/<number>.json      the pointer of a version; the highest number is current

A publication writes rows, then the list, then moves the pointer in with one rename.
Readers resolve the newest pointer first, so they see one whole version or the next. A
run lost before the rename leaves files that nothing refers to (``vacuum`` deletes
them) and can be repeated; a run lost after it is recognised by its batch name in the
pointer. There is no step at which stored rows are out of reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharf.session import write_parts

FILE = "__wharf_file"


def file_name(path: Column | None = None) -> Column:
    """A row's file as <run>/<part>, the name used in lists; ``path``: its whole path.

    No regular expression: one that is bound at the end alone is tried from every place of
    a path, for every row.
    """
    return F.substring_index(F.col("_metadata.file_path") if path is None else path, "/", -2)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, ranges: Sequence[str] = ()):
        """``ranges``: columns whose smallest and largest value is kept for every file."""
        self.spark, self.path, self.ranges = spark, path.rstrip("/"), tuple(ranges)
        self._jvm = spark.sparkContext._jvm

    # ---- pointer

    def _hadoop(self, relative: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{relative}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, relative: str) -> list[str]:
        fs, p = self._hadoop(relative)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def current(self) -> dict | None:
        """The newest pointer: version, list, schema, batches; None before the first publication."""
        numbers = [n for n in self._names("versions") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.path}/versions/{numbers[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _point(self, pointer: dict) -> None:
        """Write the pointer under another name, then rename it; an existing number is an error."""
        fs, target = self._hadoop(f"versions/{pointer['version']:012d}.json")
        _, fresh = self._hadoop(f"versions/_{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(pointer), "utf-8"))
        out.close()
        if fs.exists(target) or not fs.rename(fresh, target):
            fs.delete(fresh, False)
            raise RuntimeError(f"{self.path}: version {pointer['version']} was published by another run")

    # ---- reading

    def files(self) -> DataFrame:
        """The live files: file, n_rows, and min_/max_/nulls_ of every range column."""
        return self.spark.read.parquet(f"{self.path}/lists/{self.current()['list']}")

    def n_rows(self, files: Sequence[str]) -> int:
        """Rows of some files, by the list."""
        counts = {r["file"]: r["n_rows"] for r in self.files().select("file", "n_rows").collect()} if files else {}
        return sum(counts[f] for f in files)

    def read(self, files: Sequence[str] | None = None) -> DataFrame:
        """Rows of the current version, or of some of its files."""
        pointer = self.current()
        if pointer is None:
            raise FileNotFoundError(f"{self.path} has no published version")
        schema = T.StructType.fromJson(pointer["schema"])
        if files is None:
            files = [r["file"] for r in self.files().select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in files])

    def has_applied(self, source: str, number: int) -> bool:
        """Whether this batch of ``source``, or a later one, was published."""
        pointer = self.current()
        return pointer is not None and pointer["batches"].get(source, number - 1) >= number

    # ---- publishing

    def write(self, rows: DataFrame | Sequence[DataFrame]) -> str:
        """Write rows as files that no version refers to yet; returns the run's folder name."""
        run = uuid.uuid4().hex
        write_parts([rows] if isinstance(rows, DataFrame) else rows, f"{self.path}/data/{run}")
        return run

    def _describe(self, run: str, schema: T.StructType) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("n_rows")]
        for c in self.ranges:
            aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data/{run}")
        # Rows are grouped by the path as it is; names are taken of the groups.
        found = rows.withColumn(FILE, F.col("_metadata.file_path")).groupBy(FILE).agg(*aggs)
        return found.select(file_name(F.col(FILE)).alias("file"), *[c for c in found.columns if c != FILE])

    def _list(self, run: str, schema: T.StructType, replaced: Sequence[str] | None) -> str:
        files = self._describe(run, schema)
        if replaced is not None and self.current() is not None:
            gone = self.spark.createDataFrame([(f,) for f in replaced], "file string")
            files = self.files().join(gone, "file", "left_anti").unionByName(files)
        files.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/lists/{run}")
        return run

    def publish(self, rows: DataFrame | Sequence[DataFrame], replaced: Sequence[str] | None = None,
                batch: tuple[str, int] | None = None) -> int:
        """Make ``rows`` (or parts of them, written one after the other) live; returns the new version.

        They take the place of the files ``replaced`` (none: an append), or of the whole
        table if that is None. ``batch`` (source, number) is kept with the version.
        """
        before = self.current() or {"version": 0, "batches": {}}
        run = self.write(rows)
        schema = (rows if isinstance(rows, DataFrame) else rows[0]).schema
        listed = self._list(run, schema, replaced)
        batches = {**before["batches"], **({batch[0]: batch[1]} if batch else {})}
        version = before["version"] + 1
        self._point({"version": version, "list": listed, "schema": json.loads(schema.json()), "batches": batches})
        return version

    def vacuum(self) -> int:
        """Delete runs, lists and pointers that the current version doesn't need (no run may be under way)."""
        pointer = self.current()
        if pointer is None:
            return 0
        live = {r["file"].split("/")[0] for r in self.files().select("file").collect()}
        gone = [f"data/{n}" for n in self._names("data") if n not in live]
        gone += [f"lists/{n}" for n in self._names("lists") if n != pointer["list"]]
        gone += [f"versions/{n}" for n in self._names("versions") if n != f"{pointer['version']:012d}.json"]
        for relative in gone:
            fs, p = self._hadoop(relative)
            fs.delete(p, True)
        return len(gone)
