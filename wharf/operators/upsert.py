"""Key-based upsert with soft-delete flags and audit stamps (U-01..U-06, J-10).

MERGE semantics of the reference: a source row matches a target row on the
business key *and* ``T.InactiveInd = S.InactiveInd`` with S always FALSE, so
only active target rows can match. Matched rows take the source's values
(Create* included, as the reference does) but keep their Inactive* flags;
unmatched source rows are inserted as active; nothing is deleted.

Plain parquet has no MERGE, so the result is a new DataFrame to be written to
a fresh path and swapped in. Plan: one FULL OUTER JOIN of target and source on
the key, so either side is read once; matched rows, rows of the target alone and
rows of the source alone are told apart by two markers. Rows that cannot match
(inactive target rows; rows with a NULL in a key, unless ``null_safe``) carry a
hash of their own as one more join column, so they spread over the tasks instead
of piling up behind one key. With NULL in a key column ``=`` never matches, so
such source rows insert again on every run (U-03).

As MERGE does, the plan fails if a target row meets several source rows (U-04):
the source carries its row count per key, and a match with a count above one
raises an error instead of multiplying rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharf.operators.dedup import duplicates

# Audit column names written by every layer of the reference.
CREATE_COLS = ("CreateBy", "CreateDate", "CreateProcess")
UPDATE_COLS = ("UpdateBy", "UpdateDate", "UpdateProcess")
INACTIVE_COLS = ("InactiveInd", "InactiveReason", "InactiveDate")
LOAD_COLS = ("LoadBy", "LoadDate", "LoadProcess")

_S, _T, _N, _HIT, _ALONE = "__wharf_s", "__wharf_t", "__wharf_n", "__wharf_hit", "__wharf_alone"


@dataclass
class Audit:
    """U-06 who/when/which process; pass fixed values for deterministic tests."""
    now: Column | None = None
    user: Column | None = None
    process: str = "wharf"
    extra: dict = field(default_factory=dict)

    def stamps(self) -> dict[str, Column]:
        now = self.now if self.now is not None else F.current_timestamp()
        user = self.user if self.user is not None else F.current_user()
        proc = F.lit(self.process)
        return {"CreateBy": user, "CreateDate": now, "CreateProcess": proc,
                "UpdateBy": user, "UpdateDate": now, "UpdateProcess": proc}


def source_stamps(audit: Audit) -> dict[str, Column]:
    """S as the reference prepares it: audit stamps, active, '' reason, NULL date."""
    return {**audit.stamps(), "InactiveInd": F.lit(False), "InactiveReason": F.lit(""),
            "InactiveDate": F.lit(None).cast("timestamp")}


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str] | None = None, audit: Audit | None = None,
           null_safe: bool = False, preserve_created: bool = False,
           active_col: str = "InactiveInd") -> DataFrame:
    """U-01 MERGE upsert; returns the new target (target's schema and order).

    ``update_cols``: columns the MATCHED branch overwrites (default: every
    source column). Per-feed exclusions (U-02) are expressed by leaving
    columns out. ``preserve_created`` keeps the target's Create* on update.
    """
    audit = audit or Audit()
    stamps = source_stamps(audit)
    out_cols = target.columns
    src_cols = {*source.columns, *stamps}
    # Stamps are the same for all rows: they are put in after the join, not carried through it.
    src = source.withColumns({c: v for c, v in stamps.items() if c in keys}).drop(*[c for c in stamps if c not in keys])
    if update_cols is None:
        update_cols = [c for c in src_cols if c not in INACTIVE_COLS]
    update_cols = set(update_cols) | set(UPDATE_COLS) | set(CREATE_COLS)
    update_cols -= set(INACTIVE_COLS)
    if preserve_created:
        update_cols -= set(CREATE_COLS)

    is_active = F.coalesce(F.col(active_col) == F.lit(False), F.lit(False))
    out_types = {f.name: f.dataType for f in target.schema.fields}
    null_key = F.lit(False)
    if not null_safe:
        for k in keys:
            null_key = null_key | F.col(k).isNull()

    def spread(df: DataFrame, alone: Column) -> Column:
        # 0 for rows that may match; an odd hash of the row for those that cannot.
        plain = [c for c, t in df.dtypes if not t.startswith("map")]
        return F.when(alone, F.xxhash64(*plain).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))

    t = target.withColumn(_ALONE, spread(target, null_key | ~is_active)).withColumn(_T, F.lit(True)).alias("t")
    per_key = Window.partitionBy(*keys, _ALONE)
    s = (src.withColumn(_ALONE, spread(src, null_key)).withColumn(_S, F.lit(True))
            .withColumn(_N, F.count(F.lit(1)).over(per_key)).alias("s"))
    cond = F.col(f"t.{_ALONE}") == F.col(f"s.{_ALONE}")
    for k in keys:
        l, r = F.col(f"t.{k}"), F.col(f"s.{k}")
        cond = cond & (l.eqNullSafe(r) if null_safe else l == r)

    in_t, in_s = F.col(f"t.{_T}").isNotNull(), F.col(f"s.{_S}").isNotNull()
    checked = F.when(in_t & (F.col(f"s.{_N}") > 1),
                     F.raise_error(F.lit("merge: a target row matches several source rows"))).otherwise(in_s)
    joined = t.join(s, cond, "full_outer").withColumn(_HIT, checked)
    proj = []
    for c in out_cols:
        tv = F.col(f"t.{c}")
        sv = stamps[c] if c in stamps else F.col(f"s.{c}") if c in src_cols else F.lit(None)
        both = sv if c in update_cols and c in src_cols else tv
        proj.append(F.when(~in_t, sv).when(F.col(_HIT), both).otherwise(tv).cast(out_types[c]).alias(c))
    return joined.select(*proj)


def assert_unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U-04 source keys that would make MERGE fail (several rows for one key)."""
    return duplicates(source, keys)
