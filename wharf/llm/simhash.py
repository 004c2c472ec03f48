"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

A fingerprint bit is 1 if more than half of the text's shingle hashes have it.
Two fingerprints with at most ``DISTANCE`` differing bits, split in ``BLOCKS``
blocks, agree on at least ``BLOCKS - DISTANCE`` of them, so they share the key of
some choice of that many blocks: that is the join. It runs on distinct
fingerprints (copies never meet), and a shared key is always verified by Hamming
distance. A key with two fingerprints is settled by its smallest and largest;
larger groups are searched in tasks that give a spanning set of links (at most one
per member), never all pairs. Groups beyond ``GROUP`` members are dealt to tasks
by pairs of slices, so no task gets an unbounded group and no pair is missed.

Components of the links come from star contraction over joins and aggregates.

Defined results: null text counts as empty; texts without words have fingerprint
zero and link like any other; equal texts share a fingerprint; the component id is
the smallest doc_id of the component (null only if it has no other); rows that
repeat a doc_id each give a row; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wharf.llm.common import text_of
from wharf.llm.components import components
from wharf.session import materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7
GROUP = 20_000
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint as an unsigned integer (A-Z lower-cased, ASCII white space)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    h, data = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= k:
        return h(data, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    bits = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        got = np.array([h(data[a:b], seed) for a, b in zip(starts[at:stop].tolist(), ends[at + k - 1:stop + k - 1].tolist())],
                       dtype="<u8")
        bits += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of blocks - distance blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    out = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links within the distance that connect all that all such links connect."""
    left, links = fps.astype(np.int64).view(np.uint64), []
    while len(left):
        stack, left = [left[-1]], left[:-1]
        while stack and len(left):
            s = stack.pop()
            near = np.bitwise_count(left ^ s) <= distance
            if near.any():
                found = left[near]
                links += [(s, f) for f in found]
                stack.extend(found)
                left = left[~near]
    return links


def _searched(distance: int):
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def search(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in groups:
            yield pd.Series([[{"a": int(np.uint64(a).view(np.int64)), "b": int(np.uint64(b).view(np.int64))}
                              for a, b in spanning_links(np.asarray(g, dtype=np.int64), distance)] for g in batch])
    return search


def links_of(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect every component."""
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                     for i, m in enumerate(masks(blocks, distance))])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    shared = materialize(keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"),
                                                       F.max("fp").alias("hi")).where("n > 1"), "simhash-keys")
    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= distance
    pairs = shared.where("n = 2").where(near).select(F.col("lo").alias("a"), F.col("hi").alias("b"))

    # Larger groups: one slice, or all pairs of slices beyond GROUP members.
    slices = F.ceil(F.col("n") / group).cast("int")
    members = keyed.join(shared.where("n > 2").select("c", "key", slices.alias("slices")), ["c", "key"])
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    dealt = (members.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
             .select("c", "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    groups = dealt.groupBy("c", "key", "i", "j").agg(F.collect_list("fp").alias("fps"))
    searched = groups.select(F.explode(_searched(distance)("fps")).alias("l")).select("l.a", "l.b")
    return pairs.unionByName(searched).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """(_fp, root): the component of every fingerprint of ``rows``, named by one of them."""
    distinct = materialize(rows.select("fp").distinct(), "fingerprint-classes")
    roots = components(materialize(links_of(distinct), "simhash-links"))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long), component_id of every document."""
    rows = materialize(docs.select("doc_id", fingerprint(text_of()).alias("fp")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = materialize(distinct.join(_classes(rows), F.col("fp") == F.col("_fp")).select("_fp", "root", "first"),
                         "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("_fp", "component_id")
    return rows.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each component.

    It is the row of the smallest doc_id (null only if there is no other), then of the
    smallest text hash; of rows that repeat both, one stays.
    """
    rows = materialize(docs.select("doc_id", F.xxhash64(text_of()).alias("hash"), fingerprint(text_of()).alias("fp")),
                       "fingerprints")
    # One candidate per fingerprint first, so that copies never meet in the join.
    candidate = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    best = rows.groupBy("fp").agg(F.min(candidate).alias("c"))
    kept = materialize(best.join(_classes(rows), F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("c").alias("c"))
                       .select(F.col("c.doc_id").alias("id"), F.col("c.hash").alias("hash")), "near-kept")
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("hash"), F.struct("*").alias("row"))
    same = whole["id"].eqNullSafe(kept["id"]) & (whole["hash"] == kept["hash"])
    out = whole.join(kept, same, "left_semi")
    if rows.groupBy("doc_id", "hash").count().where("count > 1").head(1):
        out = out.dropDuplicates(["id", "hash"])
    return out.select("row.*")


def hexed(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
