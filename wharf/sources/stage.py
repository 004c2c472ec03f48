"""File intake into an all-string stage (S-01, S-02, S-03).

Workbook decoding is not built: sheets arrive as CSV files, one folder per
(ParentSystemId, SystemId, feed). Discovery is Spark's own file listing with a
glob mask; no driver-side loops over files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharf.functions.casts import instant_to_utc_ntz

_FILE, _BLOCK, _MID, _RAW = "__wharf_file", "__wharf_block", "__wharf_mid", "__wharf_raw"
MALFORMED = "Malformed row"


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def _read_sheets(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                 mask: str | Sequence[str] | None, sep: str) -> DataFrame:
    """Sheet rows with file and line; ``_RAW`` holds the text of rows with too few or too many
    fields or an open quote. All columns are always parsed, so that this does not depend on
    what is read later."""
    reader = (spark.read.schema(string_schema([*columns, _RAW]))
              .option("header", True).option("sep", sep).option("columnNameOfCorruptRecord", _RAW)
              .option("columnPruning", False)
              .option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("enforceSchema", False))
    if mask:
        reader = reader.option("pathGlobFilter", any_mask(mask))
    # Spark does not read the text of malformed rows alone: this names a data column and holds for all rows.
    some = F.coalesce(F.length(columns[0]), F.lit(0)) >= 0
    raw = reader.csv(path if isinstance(path, str) else list(path)).where(some).select(
        *columns, _RAW,
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        instant_to_utc_ntz(F.col("_metadata.file_modification_time")).alias("FileEffectiveDate"),
        F.monotonically_increasing_id().alias(_MID),
    )
    return with_line_numbers(raw)


def _lineage(parent_id: int, system_id: int, audit_id: int) -> dict[str, Column]:
    return {"ParentSystemId": F.lit(parent_id).cast("bigint"), "SystemId": F.lit(system_id).cast("bigint"),
            "FileLoadAuditId": F.lit(audit_id).cast("bigint")}


def read_stage(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], *,
               parent_id: int, system_id: int, audit_id: int,
               mask: str | Sequence[str] | None = None, load_by: str = "wharf",
               load_process: str = "wharf.read_stage", sep: str = ",", keep_malformed: bool = True) -> DataFrame:
    """S-03 load CSV sheets as strings with lineage columns.

    FileLoadAuditId = ``audit_id``; FileEffectiveDate = file modification time
    (UTC wall clock); LineNum = 1-based data line within its file. A file whose
    header is not ``columns`` in their order is an error. ``mask``: one glob or
    several, of which any may match (S-01). Rows of another number of fields are
    padded or cut; without ``keep_malformed`` they are left to ``read_rejects``.
    """
    staged = _read_sheets(spark, path, columns, mask, sep)
    if not keep_malformed:
        staged = staged.where(F.col(_RAW).isNull())
    own = _lineage(parent_id, system_id, audit_id)
    return staged.select(
        own["ParentSystemId"].alias("ParentSystemId"),
        own["SystemId"].alias("SystemId"),
        *columns,
        own["FileLoadAuditId"].alias("FileLoadAuditId"),
        "LineNum", "FileEffectiveDate",
        F.lit(load_by).alias("LoadBy"),
        F.current_timestamp().alias("LoadDate"),
        F.lit(load_process).alias("LoadProcess"),
        F.lit(False).alias("InactiveInd"),
        F.lit(None).cast("timestamp").alias("InactiveDate"),
        F.lit(None).cast("string").alias("InactiveReason"),
    )


def read_rejects(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], *,
                 parent_id: int, system_id: int, audit_id: int,
                 mask: str | Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """S-03 the malformed rows of the same files: text, file and line.

    They are inactive rows of their system, so a union with the stage (missing columns
    NULL) counts them in the V-05 summary.
    """
    rows = _read_sheets(spark, path, columns, mask, sep).where(F.col(_RAW).isNotNull())
    own = _lineage(parent_id, system_id, audit_id)
    return rows.select(*[v.alias(k) for k, v in own.items()], "LineNum", "FileEffectiveDate",
                       F.col(_FILE).alias("SourceFile"), F.col(_RAW).alias("RawRecord"),
                       F.lit(True).alias("InactiveInd"), F.current_timestamp().alias("InactiveDate"),
                       F.lit(MALFORMED).alias("InactiveReason"))


def any_mask(mask: str | Sequence[str]) -> str:
    """S-01 one glob for a file mask or a list of them."""
    return mask if isinstance(mask, str) else "{" + ",".join(mask) + "}"


def with_line_numbers(raw: DataFrame) -> DataFrame:
    """Line number per file without funnelling a file through one task.

    Rows of one (file, split) are read by one task in file order, so their
    monotonically increasing ids are consecutive. Count rows per split, turn the
    counts into per-file running offsets (one row per split: tiny), and add the
    in-split position. The only shuffle is of that tiny per-split table.
    """
    per_block = raw.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"),
                                                F.min(_MID).alias("first_mid"))
    w = (Window.partitionBy(_FILE).orderBy(_BLOCK)
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_block.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return (raw.join(offsets.select(_FILE, _BLOCK, "offset", "first_mid"), [_FILE, _BLOCK])
               .withColumn("LineNum", (F.col("offset") + F.col(_MID) - F.col("first_mid") + 1)
                           .cast("bigint"))
               .drop("offset", "first_mid", _BLOCK, _MID))


def route_by_folder(df_path_col: str = "_metadata.file_path", pattern: str = r"/([^/]+)/[^/]+$"):
    """S-02 sheet/feed routing: the feed name is the file's parent folder."""
    return F.regexp_extract(F.col(df_path_col), pattern, 1)


def route_to_feed(rules: Mapping[str, str], folder: Column | None = None, fallback: str | None = None) -> Column:
    """S-02 feed name of a row by its sheet or folder name and a table of rules.

    A name without a rule goes to ``fallback``; without one it is an error, so no file
    is loaded under a wrong feed or left out silently.
    """
    folder = route_by_folder() if folder is None else folder
    table = F.create_map(*[F.lit(v) for pair in rules.items() for v in pair])
    other = (F.lit(fallback) if fallback is not None else
             F.raise_error(F.concat(F.lit("no feed for "), F.coalesce(folder, F.lit("NULL")))).cast("string"))
    return F.coalesce(F.try_element_at(table, folder), other)
