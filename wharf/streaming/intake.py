"""K-01 incremental file intake with Structured Streaming.

The reference re-reads month-to-date workbooks once a day and lets the newest
load win. Here a file stream over the landing folder runs the feed pipeline
per micro-batch (``foreachBatch``):

  stage (CSV strings + lineage) -> validate -> snapshot rows appended under
  ``batch=<epoch>`` -> latest per key -> upsert into the ODS, a recoverable table
  (``sources.versions``) of which only files that hold the batch's keys are replaced.

Only the batch's own snapshot rows feed the upsert: they carry the newest
LoadDate, so for every key they touch the latest row is among them, and the
cost per micro-batch is the batch plus the ODS files it touches.

Exactly-once: each epoch overwrites only its own ``batch=<epoch>`` snapshot
folder, so a replayed epoch (after a failure) rewrites the same rows instead
of appending them twice; the ODS publishes rows and epoch with one rename, so an
epoch lost at any step is either not there at all or recognised and left alone; the
file source's checkpoint remembers which files were consumed. A re-delivered month-to-date file is idempotent at the ODS:
its rows are newer loads of the same keys, so the upsert updates in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wharf.functions.casts import instant_to_utc_ntz
from wharf.operators.upsert import Audit
from wharf.plans import feeds
from wharf.sources.stage import _BLOCK, _FILE, _MID, any_mask, string_schema, with_line_numbers


def _stage_batch(batch: DataFrame, spec: feeds.FeedSpec, parent_id: int, system_id: int,
                 epoch_id: int, process: str) -> DataFrame:
    staged = with_line_numbers(batch.withColumn(_MID, F.monotonically_increasing_id()))
    return staged.select(
        F.lit(parent_id).cast("bigint").alias("ParentSystemId"),
        F.lit(system_id).cast("bigint").alias("SystemId"),
        *spec.columns,
        # One audit id per file and run: (FileLoadAuditId, LineNum) names a row.
        F.pmod(F.xxhash64(F.lit(epoch_id), F.col(_FILE)), F.lit(1 << 62)).alias("FileLoadAuditId"),
        "LineNum", "FileEffectiveDate",
        F.current_user().alias("LoadBy"), F.current_timestamp().alias("LoadDate"),
        F.lit(process).alias("LoadProcess"),
        F.lit(False).alias("InactiveInd"), F.lit(None).cast("timestamp").alias("InactiveDate"),
        F.lit(None).cast("string").alias("InactiveReason"))


def process_batch(spark: SparkSession, batch: DataFrame, epoch_id: int, spec: feeds.FeedSpec,
                  parent_id: int, system_id: int, snapshot_path: str, ods_path: str,
                  process: str = "wharf.intake", carry_rejects: bool = True, stream: str = "intake") -> None:
    """One micro-batch of the feed pipeline (also usable as a plain batch job).

    ``stream`` names the source of the epochs; an epoch that was published changes nothing.

    Rejected rows are carried as in ``stage_to_snapshot``; text that the strict
    casts of the ODS load cannot take then fails the batch. ``carry_rejects=False``
    leaves rejects out.
    """
    ods = feeds.ods_table(spark, ods_path, spec)
    if ods.has_applied(stream, epoch_id):                     # published before the driver was lost
        return
    audit = Audit(process=process)
    stage = _stage_batch(batch, spec, parent_id, system_id, epoch_id, process)
    validated = feeds.validate_stage(stage, spec)
    snap = feeds.snapshot_rows(validated, spec, audit, carry_rejects)
    (snap.write.mode("overwrite").partitionBy("ParentSystemId")
         .parquet(f"{snapshot_path.rstrip('/')}/batch={epoch_id}"))
    # Every row of this batch was loaded after all earlier history, so for the
    # keys it touches the latest row is in the batch: dedupe the batch alone
    # instead of re-reading the whole snapshot history every micro-batch.
    written = spark.read.schema(snap.schema).parquet(f"{snapshot_path.rstrip('/')}/batch={epoch_id}")
    source = feeds.ods_source(written, spec, audit)
    feeds.merge_ods_table(ods, source, spec, audit, (stream, epoch_id))


def incremental_intake(spark: SparkSession, landing: str, spec: feeds.FeedSpec, *,
                       parent_id: int, system_id: int, snapshot_path: str, ods_path: str,
                       checkpoint: str, mask: str | None = None,
                       available_now: bool = True, carry_rejects: bool = True) -> StreamingQuery:
    """Start the intake stream; ``available_now`` processes what has landed, then stops."""
    reader = (spark.readStream.schema(string_schema(spec.columns))
              .option("header", True).option("recursiveFileLookup", True).option("enforceSchema", False))
    if mask:
        reader = reader.option("pathGlobFilter", any_mask(mask))
    stream = reader.csv(landing).select(
        *spec.columns,
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        instant_to_utc_ntz(F.col("_metadata.file_modification_time")).alias("FileEffectiveDate"))

    def run(batch: DataFrame, epoch_id: int) -> None:
        process_batch(spark, batch, epoch_id, spec, parent_id, system_id, snapshot_path, ods_path,
                      carry_rejects=carry_rejects, stream=checkpoint)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def unique_rows(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """K-01 rows of a stream without repeats of their business key.

    The first row of a key passes; repeats whose event times lie within ``delay`` of each
    other do not. State is kept for that long only, so it does not grow with the stream.
    Late rule: a row older than the newest event time less ``delay`` (as of the batches
    before) is dropped, whether or not its key was seen; a key that comes again after its
    state has expired passes again. NULL is a key like any other.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
