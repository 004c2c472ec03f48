"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives every document of it the same expected number of copies,
``target / source_size`` (0 to 2). The whole part is taken; the fraction is a
probability that pairs of documents settle between them: words move from one to
the other until one of the two is at 0 or 1, by a draw that leaves both
expectations as they were. A source's expected words thus never change, and one
fractional document is left. Documents are dealt to groups of ``GROUP`` by a hash,
so a hot source is many groups; what each leaves over is combined by a tree of the
same step. The last one of a source is rounded, and settled rows of its group make up for the words that this gives or takes.

Draws follow from a hash of the documents, so reruns agree. Defined results: null
text has size 0; documents of size 0 take 0 words; null is a source of its own and
comes last; rows that repeat a doc_id are mixed one by one; an empty table, or one
without words, takes nothing; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharf.llm.common import SPACES, text_of
from wharf.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2
GROUP = 4096
FAN_IN = 64
_LEFT = "_row long, _key long, size long, p double, source_no int, bucket long, extra int"


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_no, source_size, rows, target from (source, size) rows.

    Sources by code point (null last) take ``weights`` in turn. Where a source's
    limit is below its part, it gets the limit and the rest is shared anew: in
    order of limit per weight the limited ones come first, so one running sum over
    the sources (not the documents) finds them.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    all_rows = Window.partitionBy()
    s = by.withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    s = (s.withColumn("_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_no", F.lit(len(weights)))))
          .withColumn("_cap", F.col("source_size") * limit)
          .withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(share)))
    in_order = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no")
    before, onward = (in_order.rowsBetween(Window.unboundedPreceding, -1),
                      in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(onward)
    s = s.withColumn("_limited", level * F.col("_w") > F.col("_cap"))
    rest = F.col("_total") - F.sum(F.when(F.col("_limited"), F.col("_cap")).otherwise(0)).over(all_rows)
    open_w = F.sum(F.when(F.col("_limited"), 0.0).otherwise(F.col("_w"))).over(all_rows)
    s = s.withColumn("_rest", rest).withColumn("_open", open_w)
    return s.select("source", "source_no", "source_size", "rows",
                    F.when(F.col("_limited"), F.col("_cap").cast("double"))
                     .otherwise(F.col("_rest") * F.col("_w") / F.col("_open")).alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Settle all but one fraction. Returns probabilities (0 or 1 but for one) and its
    place (-1: none is left). Words, size * p, are only ever moved."""
    p, open_ = p.astype(float).copy(), -1
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if open_ < 0:
            open_ = k
            continue
        i, a, b = open_, float(size[open_]), float(size[k])
        up, down = min(a * (1 - p[i]), b * p[k]), min(a * p[i], b * (1 - p[k]))  # words to i, from i
        words = up if draws[k] * (up + down) < down else -down
        p[i], p[k] = p[i] + words / a, p[k] - words / b
        for x in (i, k):
            if p[x] < 1e-9 or p[x] > 1 - 1e-9:
                p[x] = round(p[x])
        open_ = i if 0 < p[i] < 1 else k if 0 < p[k] < 1 else -1
    return p, open_


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group: decided rows get ``extra`` 0 or 1, the open one -1."""
    pdf = pdf.sort_values(["_key", "size"], kind="stable")
    draws = (pdf["_key"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
    # The larger documents settle first, so that what stays open is small.
    order = np.argsort(-pdf["size"].to_numpy(), kind="stable")
    pdf, draws = pdf.iloc[order], draws[order]
    p, left = pivotal(pdf["size"].to_numpy(), pdf["p"].to_numpy(), draws)
    extra = np.rint(p).astype(np.int32)
    if left >= 0:
        extra[left] = -1
    return pdf.assign(p=p, extra=extra)[["_row", "_key", "size", "p", "source_no", "bucket", "extra"]]


def _settle_last(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last group of a source: its open row is rounded to the nearer side, and the
    words that this gives or takes go back through settled rows, the largest that fits
    first, so that the source ends within a small document of its target."""
    out = _settle(pdf)
    extra, size = out["extra"].to_numpy().copy(), out["size"].to_numpy()
    for k in np.flatnonzero(extra < 0):
        p = float(out["p"].iloc[k])
        extra[k] = int(np.rint(p))
        missing = size[k] * (p - extra[k])
        for j in np.argsort(-size, kind="stable"):
            if j != k and extra[j] == (0 if missing > 0 else 1) and size[j] <= abs(missing):
                extra[j] = 1 - extra[j]
                missing += -size[j] if missing > 0 else size[j]
    return out.assign(extra=extra)


def _dealt(rows: DataFrame, seed: int) -> DataFrame:
    """The fractional rows with key and first-level bucket, by a hash of all that tells rows
    apart and a number among those equal in it: null or repeated doc_ids spread as well."""
    same = Window.partitionBy("source_no", "doc_id", "size", "_hash").orderBy("_row")
    told = [F.coalesce("doc_id", F.lit(-1)), "size", "_hash", "_copy"]
    groups = F.ceil(F.col("rows") / GROUP).cast("long")
    return (rows.where((F.col("p") > 0) & (F.col("size") > 0)).withColumn("_copy", F.row_number().over(same))
            .select("_row", F.xxhash64(F.lit(seed), *told).alias("_key"), "size", "p", "source_no",
                    F.pmod(F.xxhash64(*told, F.lit(seed)), groups).alias("bucket")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = 7,
        extra_columns: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sized = materialize(docs.select("doc_id", "source", size_of(text_of()).alias("size"),
                                    F.xxhash64(text_of()).alias("_hash"), F.monotonically_increasing_id().alias("_row"), *extra_columns), "mix-sizes")
    per = materialize(targets(sized, weights, share, limit), "mix-targets")
    most = per.agg(F.max("rows")).first()[0] or 0
    per = per.withColumnRenamed("source", "_source")
    joined = sized.join(per, sized["source"].eqNullSafe(per["_source"])).drop("_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (joined.withColumn("_e", expected).withColumn("whole", F.floor("_e").cast("int"))
            .withColumn("p", F.col("_e") - F.col("whole")))
    fractions = _dealt(rows, seed)
    decided, width = None, -(-most // GROUP)
    while True:
        step = _settle if width > 1 else _settle_last
        level = materialize(fractions.groupBy("source_no", "bucket").applyInPandas(step, _LEFT), "mix-level")
        done = level.where("extra >= 0").select("_row", "extra")
        decided = done if decided is None else decided.unionByName(done)
        if width <= 1:
            break
        width = -(-width // FAN_IN)
        fractions = level.where("extra < 0").drop("extra").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    decided = decided.withColumnRenamed("_row", "_r")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return (rows.join(decided, F.col("_row") == F.col("_r"), "left")
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (F.col("size") * copies).cast("long").alias("taken"), *extra_columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: columns of ``docs``, then ``copies`` (how often the
    row is taken, at least 1) and ``target`` (words of its source in the mix).

    Rows that repeat doc_id, source and text become one row with their copies
    together. Columns of ``docs`` named copies or target give way.
    """
    keyed = docs.withColumn("_w_hash", F.xxhash64(text_of()))
    counted = (mix(keyed, extra_columns=("_w_hash",), **options)
               .groupBy(F.col("doc_id").alias("_w_id"), F.col("source").alias("_w_source"), F.col("_w_hash").alias("_w_key"))
               .agg(F.sum("copies").alias("_w_copies"), F.max("target").alias("_w_target"), F.count(F.lit(1)).alias("_w_rows")))
    counted = materialize(counted.where("_w_copies > 0"), "mix-copies")
    met = keyed.join(counted, keyed["doc_id"].eqNullSafe(F.col("_w_id")) & keyed["source"].eqNullSafe(F.col("_w_source"))
                     & (F.col("_w_hash") == F.col("_w_key")))
    if counted.where("_w_rows > 1").head(1):
        met = met.dropDuplicates(["doc_id", "source", "_w_hash"])
    return met.select(*[F.col(c) for c in docs.columns if c not in ("copies", "target")],
                      F.col("_w_copies").alias("copies"), F.col("_w_target").alias("target"))
