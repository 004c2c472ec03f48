"""U-01/J-10 merge of a delivery into a large table, touching only files that can match.

1. Ranges: the table's list of files holds the smallest and largest value of chosen key
   columns; files outside the delivery's box are not opened.
2. Bloom filter: the delivery's keys become a bit table of bounded size (a scalar
   subquery, no join). Of the files left, key columns alone are scanned for rows that
   may match; files without one are not touched.
3. Of the touched files, rows that may match meet the delivery in ``upsert`` (same MERGE
   semantics: U-03 NULL keys, U-04 guard); all others are copied in place. So the
   exchange holds the delivery and about as many rows of the table, not the table.
4. The result replaces the touched files in one publication (``VersionedTable``).

A false positive costs a copied file or a row in the join, never a wrong row. Beyond
``MOST_BITS`` the filter lets more rows through and the merge approaches the plain one.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.operators.slices import slice_count, sliced, take_slice
from wharf.operators.upsert import Audit, upsert
from wharf.session import materialize, written
from wharf.sources.versions import FILE, VersionedTable, file_name

BITS_PER_KEY = 16
HASHES = 4
LEAST_BITS = 1 << 13
MOST_BITS = 1 << 26          # 8 MB


def _positions(keys: Sequence[Column], bits: int) -> list[Column]:
    one, two = F.xxhash64(*keys), F.xxhash64(*keys, F.lit("second"))
    # Wrapping arithmetic: the low bits of both hashes are all that counts.
    low = F.lit(bits - 1)
    a, b = one.bitwiseAND(low), two.bitwiseAND(low)
    return [(a + i * b).bitwiseAND(low) for i in range(HASHES)]


class KeyFilter:
    """A Bloom filter of the keys of ``source``; types are those of ``target``."""

    def __init__(self, source: DataFrame, target: DataFrame, keys: Sequence[str]):
        spark, types = source.sparkSession, {f.name: f.dataType for f in target.schema}
        self.keys = [F.col(k).cast(types[k]) for k in keys]
        n = source.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
        at = source.select(F.explode(F.array(*_positions(self.keys, self.bits))).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("id")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS INT))")).alias("w"))
        dense = spark.range(self.bits // 64).join(words, "id", "left").select(
            F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")).alias("s"))
        self.table = materialize(dense.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["w"]).alias("words")),
                                 "key-filter")

    def may_match(self) -> Column:
        words = self.table.scalar()
        tests = [F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")),
                                 p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
                 for p in _positions(self.keys, self.bits)]
        return reduce(lambda x, y: x & y, tests)


def files_in_range(table: VersionedTable, source: DataFrame, null_safe: bool = False) -> list[str]:
    """Files whose ranges meet the box of the source's values, by the list alone.

    NULLs lie in no range; with ``null_safe`` a file that holds one stays in.
    """
    files = table.files()
    ranges = [c for c in table.ranges if c in source.columns]
    if ranges:
        types = {f.name: f.dataType for f in files.schema}
        box = source.agg(*[f(F.col(c).cast(types[f"min_{c}"])).alias(f"{n}_{c}") for c in ranges
                           for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for c in ranges:
            meets = F.lit(False)
            if box[f"lo_{c}"] is not None:
                meets = (F.col(f"max_{c}") >= F.lit(box[f"lo_{c}"])) & (F.col(f"min_{c}") <= F.lit(box[f"hi_{c}"]))
            files = files.where(F.coalesce(meets, F.lit(False)) | ((F.col(f"nulls_{c}") > 0) if null_safe else F.lit(False)))
    return [r["file"] for r in files.select("file").collect()]


def touched_rows(table: VersionedTable, source: DataFrame, keys: Sequence[str], only: Column | None = None,
                 null_safe: bool = False) -> tuple[list[str], DataFrame, DataFrame]:
    """(files that may hold a key of ``source``, their rows that may match, their other rows).

    ``only`` leaves out rows that cannot match for another reason. ``source`` is read
    several times, so it should be a written table.
    """
    hit = KeyFilter(source, table.read([]), keys).may_match()
    hit = F.coalesce(hit if only is None else only & hit, F.lit(False))
    near, files = files_in_range(table, source, null_safe), []
    if near:
        found = table.read(near).withColumn(FILE, F.col("_metadata.file_path")).where(hit).select(FILE).distinct()
        files = sorted(r[0] for r in found.select(file_name(F.col(FILE))).collect())
    rows = table.read(files)
    return files, rows.where(hit), rows.where(~hit)


def merged_files(table: VersionedTable, source: DataFrame, keys: Sequence[str],
                 update_cols: Sequence[str] | None = None, audit: Audit | None = None,
                 null_safe: bool = False, active_col: str = "InactiveInd", **kw) -> tuple[list[str], DataFrame]:
    """(files to replace, rows that replace them)."""
    files, near, others = touched_rows(table, source, keys, F.col(active_col) == F.lit(False), null_safe)
    merged = upsert(near, source, keys, update_cols, audit, null_safe=null_safe, active_col=active_col, **kw)
    return files, merged.unionByName(others) if files else merged


def merge_into(table: VersionedTable, source: DataFrame, keys: Sequence[str],
               update_cols: Sequence[str] | None = None, audit: Audit | None = None,
               batch: tuple[str, int] | None = None, stored: bool = False, slice_by: Sequence[str] = (),
               null_safe: bool = False, active_col: str = "InactiveInd", **kw) -> list[str]:
    """Merge and publish; returns the files that were replaced.

    A ``batch`` (source, number) that was published already changes nothing. ``stored``: the
    source is a plain read of written rows, no copy is needed to read it several times. Large
    merges are done in slices by ``slice_by``, some of ``keys`` (none: all).
    """
    if batch is not None and table.has_applied(*batch):
        return []
    with nullcontext(source) if stored else written(source, "delivery") as source:
        files, near, others = touched_rows(table, source, keys, F.col(active_col) == F.lit(False), null_safe)
        types = {f.name: f.dataType for f in near.schema}
        by = [F.col(k).cast(types[k]) for k in slice_by or keys]
        n = slice_count(source.count() + table.n_rows(files))
        table.publish(sliced(lambda i: upsert(take_slice(near, by, i, n), take_slice(source, by, i, n), keys, update_cols,
                                              audit, null_safe=null_safe, active_col=active_col, **kw),
                             n, others if files else None), files, batch)
    return files
