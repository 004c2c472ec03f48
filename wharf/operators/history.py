"""Tables kept run by run, so that a run or a read costs its delivery and not the history.

``advance_latest`` (W-01): the latest row of every key, with its order columns. A
delivery meets only the stored rows of files that may hold its keys; the rows that it
won are what the ODS has to merge.

``record_run`` (W-01, F-01): every version of a key with the time from which and until
which it is the newest. A run sets the intervals of the keys it brings, late versions
included; a read "as of" is a filter, no window over all rows.

Both publish with the batch, so a repeated run changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharf.operators.dedup import latest_per_key
from wharf.operators.merge_files import touched_rows
from wharf.operators.slices import slice_count, sliced, take_slice
from wharf.session import written
from wharf.sources.versions import VersionedTable

KEY, BATCH = "key_", "won_in_batch"
VALID_FROM, VALID_TO, NEWEST = "valid_from", "valid_to", "is_newest"


def advance_latest(table: VersionedTable, rows: DataFrame, keys: Sequence[Column], order: Sequence[str],
                   tiebreak: Sequence[str], batch: tuple[str, int], slice_by: Sequence[str] = ()) -> DataFrame:
    """Take a delivery into the table of latest rows; returns the rows that it won.

    Keys are kept as columns ``key_0``.. (NULL is a key like any other). Of rows equal in
    all order columns the delivered one wins. The table's ranges should hold
    ``won_in_batch`` and a key column that runs with time. A delivery to a table that has
    rows is read several times, so it should be a written table. Large ones are done in
    slices by columns ``slice_by`` that follow from the key (none: the key).
    """
    names = [f"{KEY}{i}" for i in range(len(keys))]
    if not table.has_applied(*batch):
        new = rows.withColumns(dict(zip(names, keys)))
        own = new.withColumn(BATCH, F.lit(batch[1]).cast("long"))
        files, others = None, None
        if table.current() is not None:
            files, near, others = touched_rows(table, new, names, null_safe=True)
            own = near.unionByName(own)
        n = slice_count(rows.count() + table.n_rows(files or []))
        table.publish(sliced(lambda i: latest_per_key(take_slice(own, slice_by or names, i, n), names, list(order),
                                                      [*tiebreak, BATCH]), n, others), files, batch)
    files = table.files().where(F.col(f"max_{BATCH}") >= batch[1]) if BATCH in table.ranges else table.files()
    won = table.read([r["file"] for r in files.select("file").collect()])
    return won.where(F.col(BATCH) == batch[1]).drop(*names, BATCH)


def record_run(table: VersionedTable, rows: DataFrame, keys: Sequence[str], order: Sequence[str],
               tiebreak: Sequence[str], batch: tuple[str, int], slice_by: Sequence[str] = ()) -> None:
    """Add a run's versions and set the validity of the versions of the same keys.

    A version is valid from its first order column until that of the next version under
    ``order`` and ``tiebreak``; versions with one time leave an empty interval but for
    the newest. Large runs are done in slices by ``slice_by``, some of ``keys`` (none: all).
    """
    if table.has_applied(*batch):
        return
    rising = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in (*order, *tiebreak)])
    marks = {VALID_TO: F.lead(VALID_FROM).over(rising), NEWEST: F.lead(F.lit(1)).over(rising).isNull()}

    def publish(versions: DataFrame, n_rows: int, files: Sequence[str], others: DataFrame | None = None) -> None:
        n = slice_count(n_rows)
        table.publish(sliced(lambda i: take_slice(versions, slice_by or keys, i, n).withColumns(marks), n, others), files, batch)

    new = rows.withColumn(VALID_FROM, F.col(order[0]))
    if table.current() is None:
        publish(new, new.count(), [])
        return
    with written(new, "versions") as new:                      # read several times
        files, near, others = touched_rows(table, new, keys, null_safe=True)
        publish(near.drop(VALID_TO, NEWEST).unionByName(new), new.count() + table.n_rows(files), files, others)


def valid_at(versions: DataFrame, at: Column | None = None) -> DataFrame:
    """The versions that were the newest of their key at a time; without one, now."""
    if at is None:
        return versions.where(NEWEST)
    begun = F.col(VALID_FROM).isNull() | (F.col(VALID_FROM) <= at)
    return versions.where(begun & (F.col(NEWEST) | (F.col(VALID_TO) > at)))


def files_between(table: VersionedTable, column: str, start: Column, end: Column) -> list[str]:
    """Files that can hold a value of ``column`` (one of the table's ranges) in [start, end]."""
    files = table.files().where((F.col(f"max_{column}") >= start) & (F.col(f"min_{column}") <= end))
    return [r["file"] for r in files.select("file").collect()]
