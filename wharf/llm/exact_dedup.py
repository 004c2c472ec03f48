"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Texts are equal when identical after lower-casing A-Z only. Each level only
looks closer at the groups that the level before left with several rows:

1. rows per octet length and hash of the first characters, in one thin
   aggregate (a hot group becomes one row per map task before any shuffle);
2. lengths with several rows, then prefixes with several rows inside them;
3. the full hash, for rows of those prefixes only. Which rows these are is told
   by a bitmap of fixed size (``BITMAP_BITS``: 1 MB, the only thing broadcast),
   so no text is ever shuffled. A bit shared by chance merely hashes a text in
   vain; it cannot join two groups, which the full hash alone decides.

Defined results: null text counts as empty; empty texts are one group; among
equal texts the largest doc_id stays (null doc_ids sort below all others), and
of rows that repeat it exactly one stays; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharf.llm.common import ascii_lower, text_of
from wharf.session import materialize

BITMAP_BITS = 1 << 23


def exact_dedup(docs: DataFrame, prefix_chars: int = 256, hash_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, full_hash.

    ``full_hash`` is null for rows that the first two levels found unique,
    unless ``hash_all`` asks for it.
    """
    base = (docs.select("doc_id", text_of().alias("_t"))
                .select("doc_id", ascii_lower(F.col("_t")).alias("_n"))
                .select("doc_id", "_n", F.octet_length("_n").alias("_len"),
                        F.xxhash64(F.substring("_n", 1, prefix_chars)).alias("_prefix")))
    groups = materialize(base.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_rows")),
                         "dedup-prefixes")
    lengths = groups.groupBy("_len").agg(F.sum("_rows").alias("_in_len")).where("_in_len > 1")
    survivors = groups.where("_rows > 1").join(lengths, "_len", "left_semi")
    bit = F.pmod(F.xxhash64("_len", "_prefix"), F.lit(BITMAP_BITS)) + 1
    bitmap = materialize(
        survivors.select(bit.alias("_bit"))
        .groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")), "dedup-bitmap")

    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    looked = (base.withColumn("_bit", bit)
                  .join(F.broadcast(bitmap), F.bitmap_bucket_number("_bit") == F.col("_bucket"), "left")
                  .withColumn("_again", hit))
    full = F.sha2("_n", 256)
    rows = materialize(looked.select(
        "doc_id", F.monotonically_increasing_id().alias("_row"), "_again",
        (full if hash_all else F.when(F.col("_again"), full)).alias("full_hash")), "dedup-rows")

    # Written, so that the join below stands alone and Spark can split its hot keys.
    copies = materialize(rows.where("_again").groupBy(F.col("full_hash").alias("_h"))
                         .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("doc_id", "_row")).alias("_k"))
                         .where("_n > 1"), "dedup-copies")
    grouped = (rows.where("_again").join(copies, F.col("full_hash") == F.col("_h"), "left")
               .select("doc_id", F.when(F.col("_n").isNull(), F.col("doc_id"))
                                  .otherwise(F.col("_k.doc_id")).alias("keep_id"),
                       F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
                       F.coalesce(F.col("_k._row") == F.col("_row"), F.lit(True)).alias("kept"),
                       "full_hash"))
    alone = rows.where("NOT _again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "full_hash")
    return grouped.unionByName(alone)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns.

    The thin decisions meet the texts in one join on doc_id and hash. Rows that
    repeat both are told apart only where the decisions hold such rows.
    """
    keep = materialize(exact_dedup(docs, hash_all=True).where("kept")
                       .select(F.col("doc_id").alias("_keep_id"), F.col("full_hash").alias("_keep_hash")),
                       "dedup-kept")
    hashed = docs.withColumn("_w_hash", F.sha2(ascii_lower(text_of()), 256))
    out = hashed.join(keep, hashed["doc_id"].eqNullSafe(F.col("_keep_id"))
                      & (F.col("_w_hash") == F.col("_keep_hash")), "left_semi")
    repeated = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.head(1):
        out = out.dropDuplicates(["doc_id", "_w_hash"])
    return out.drop("_w_hash")
