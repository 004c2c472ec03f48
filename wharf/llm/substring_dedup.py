"""Substring duplicates: remove words covered by windows of ``WINDOW`` words that
also start in a document with a smaller doc_id.

The reference is the whole corpus, so it is narrowed before anything is matched:

1. Copies. Of documents with the same text only the one with the smallest doc_id
   can be a reference, and the others lose all their words (from ``WINDOW`` words
   on). A bitmap of those first documents lets the scans skip the others.
2. Seeds. Each window is known by the smallest hash of its 5-word runs, so equal
   windows have equal seeds and a text has few distinct ones. Seeds that occur in
   two documents go, in shards, into bitmaps of fixed size which are broadcast; where
   more than ``MAX_SHARDS`` would be needed, they stay a table, and the documents' seeds
   are joined with it instead.
3. Streaming. Each seed of a document is asked of its own shard; windows with a repeated
   seed are candidates. Neighbouring candidates with one seed make a segment. Where
   all segments of a seed are equal, its smallest doc_id decides for all of them;
   else their windows are compared one by one, by seed and hash (128 bits). Smallest
   doc_ids come from aggregates and are joined back; windows of larger doc_ids are
   marked and their words removed.

A bit set by chance adds candidates but never a removal. Suffix automata of the
whole reference do not fit the limits (figures in README); the windows that
remain after narrowing are matched by hash instead, which gives the same rows.

Defined results: null text has no words; texts under ``WINDOW`` words keep them
all; a null doc_id is neither smaller nor larger than any other, so such rows
keep all words; rows that repeat a doc_id are one document for the comparison and
each give a row; an empty table gives an empty result; texts of any length are hashed in
pieces; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wharf.llm.bitmaps import bit_of, build, test
from wharf.llm.common import shuffles_freed, text_of
from wharf.session import materialize

WINDOW = 13
RUN = 5
#: Bits of the bitmap of first documents, and of each shard of repeated seeds.
FIRST_BITS = 1 << 26
SEED_BITS = 1 << 27
#: A shard holds at most this many repeated seeds.
SHARD_SEEDS = 1 << 25
#: As many bitmaps (16 MB each) are held at once.
MAX_SHARDS = 8

#: A seed's shard is taken from bits that its bit number does not use.
_SHARD_SHIFT = 28
_PIECE = 1 << 18
_MULT = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Windows:
    """Hashes of words, seeds and windows of a text."""

    def __init__(self):
        self.power = _powers(_MULT, _PIECE + 1)
        self.inverse = _powers(pow(_MULT, -1, 1 << 64), _PIECE + 1)

    def words(self, data: bytes) -> np.ndarray:
        """A 64-bit hash per word, in pieces that end at white space."""
        parts, at = [], 0
        while at < len(data):
            stop = min(len(data), at + _PIECE)
            if stop < len(data):
                cut = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, stop - at, at)])
                if not len(cut):  # one very long word
                    rest = data[at:].split(None, 1)[0]
                    digest = hashlib.blake2b(rest, digest_size=8).digest()
                    parts.append(np.frombuffer(digest, np.uint64))
                    at = data.index(rest, at) + len(rest)
                    continue
                stop = at + int(cut[-1]) + 1
            parts.append(self._piece(np.frombuffer(data, np.uint8, stop - at, at)))
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _piece(self, b: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[:len(b)], out=total[1:])
        return _mix((total[end] - total[start]) * self.inverse[start])

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, seed of each window, hash of each window)."""
        w = self.words(data)
        none = np.zeros(0, np.uint64)
        if len(w) < WINDOW:
            return w, none, none
        run = np.zeros(len(w) - RUN + 1, np.uint64)
        for j in range(RUN):
            run = run * np.uint64(_MULT) + w[j:len(w) - RUN + 1 + j]
        run = _mix(run)
        n = len(w) - WINDOW + 1
        seed = run[:n].copy()
        for j in range(1, WINDOW - RUN + 1):
            np.minimum(seed, run[j:j + n], out=seed)
        whole = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + w[j:j + n]
        return w, seed, _mix(whole)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _kept(data: bytes, covered: np.ndarray | None) -> tuple[int, str]:
    """Number of removed words and the hash of the others, joined by a space."""
    words = data.split()
    if covered is not None and covered.any():
        words = [w for w, c in zip(words, covered.tolist()) if not c]
    return (0 if covered is None else int(covered.sum())), hashlib.sha256(b" ".join(words)).hexdigest()


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _first_documents(docs: DataFrame) -> np.ndarray:
    """Bitmap of (smallest doc_id, text) over groups of equal texts."""
    first = docs.select("doc_id", F.md5(text_of()).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return build(first.select(bit_of(F.xxhash64("doc_id", "h"), FIRST_BITS).alias("b")),
                         "b", FIRST_BITS)


def _own_bit():
    """Bit of the row in the bitmap of first documents; -1: the row is always looked at."""
    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(
        bit_of(F.xxhash64("doc_id", F.md5(text_of())), FIRST_BITS))


def _is_first(bitmap: np.ndarray, bits: pd.Series) -> np.ndarray:
    b = bits.to_numpy(np.int64)
    return (b < 0) | test(bitmap, np.maximum(b, 0))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    with shuffles_freed(docs.sparkSession):
        return _remove_repeats(docs)


def _remove_repeats(docs: DataFrame) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    first = sc.broadcast(_first_documents(docs))

    @F.pandas_udf("array<long>")
    def seeds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        windows = Windows()
        for texts, bits in batches:
            use = _is_first(first.value, bits)
            yield pd.Series([_signed(np.unique(windows.of(_encode(t))[1])) if u else []
                             for t, u in zip(texts, use)])

    repeated = materialize(docs.select(F.explode(seeds(text_of(), _own_bit())).alias("seed"))
                           .groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "seeds")
    shards = max(1, -(-repeated.count() // SHARD_SEEDS))
    rows = docs.select("doc_id", text_of().alias("_t"), _own_bit().alias("_bit"))
    if shards > MAX_SHARDS:
        # Too many for bitmaps: the join tells each document its repeated seeds.
        rows = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "rows", "zstd")
        met = (rows.select("_id", F.explode(seeds("_t", "_bit")).alias("seed")).join(repeated, "seed", "left_semi")
               .groupBy("_id").agg(F.collect_list("seed").alias("_hits")))
        rows = rows.join(met, "_id", "left").drop("_id")
        return _finish(materialize(_candidates(rows, first, None), "windows", "zstd"))
    low = F.shiftrightunsigned("seed", 1)  # not negative
    parts = [build(repeated.where(F.pmod(F.shiftrightunsigned("seed", _SHARD_SHIFT), F.lit(shards)) == s)
                           .select(bit_of(low, SEED_BITS).alias("b")), "b", SEED_BITS) for s in range(shards)]
    rows = rows.withColumn("_hits", F.lit(None).cast("array<long>"))
    return _finish(materialize(_candidates(rows, first, parts), "windows", "zstd"))


def _candidates(rows: DataFrame, first, parts: list[np.ndarray] | None) -> DataFrame:
    """One row per document: its words, and the windows whose seed is repeated, as the bitmaps
    ``parts`` say or, without them, as the row's ``_hits`` do."""
    sc = rows.sparkSession.sparkContext
    shared = [sc.broadcast(p) for p in parts or ()]

    def repeated_seeds(seed: np.ndarray, hits) -> np.ndarray:
        if not shared:
            return np.isin(_signed(seed), np.asarray([] if hits is None else hits, np.int64))
        number = ((seed >> np.uint64(1)) % np.uint64(SEED_BITS)).astype(np.int64)
        if len(shared) == 1:
            return test(shared[0].value, number)
        own = (seed >> np.uint64(_SHARD_SHIFT)) % np.uint64(len(shared))
        hit = np.zeros(len(seed), bool)
        for s in np.unique(own).tolist():
            mine = own == s
            hit[mine] = test(shared[s].value, number[mine])
        return hit

    @F.pandas_udf("n_words long, gone boolean, kept_sha256 string, seed array<long>, segment array<long>, "
                  "at array<int>, n array<int>, first array<int>, hash array<long>")
    def look(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        windows = Windows()
        for texts, bits, asked in batches:
            rows = []
            for text, use, hits in zip(texts, _is_first(first.value, bits), asked):
                data = _encode(text)
                if not use:
                    n = len(data.split())  # a copy of an earlier document
                    gone = n >= WINDOW
                    rows.append((n, gone, _kept(b"" if gone else data, None)[1], [], [], [], [], [], []))
                    continue
                w, seed, whole = windows.of(data)
                at = np.flatnonzero(repeated_seeds(seed, hits))
                if not len(at):
                    rows.append((len(w), False, _kept(data, None)[1], [], [], [], [], [], []))
                    continue
                start, n, segment = segments(at, seed[at], whole[at])
                rows.append((len(w), False, None, _signed(seed[at[start]]), _signed(segment),
                             at[start].astype(np.int32), n.astype(np.int32), start.astype(np.int32), _signed(whole[at])))
            yield pd.DataFrame(rows, columns=["n_words", "gone", "kept_sha256", "seed", "segment", "at", "n", "first", "hash"])

    return (rows.select("doc_id", "_t", look("_t", "_bit", "_hits").alias("w"))
                .select("doc_id", F.monotonically_increasing_id().alias("_row"), "w.*",
                        F.when(F.size("w.at") > 0, F.col("_t")).alias("_t")))


def segments(at: np.ndarray, seed: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows (at ``at``) with one seed: first index, length, hash."""
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seed[1:] != seed[:-1])])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(at)))
    place = (np.arange(len(at)) - np.repeat(start, n)).astype(np.uint64)
    return start, n, _mix(np.add.reduceat(_mix(whole + place * np.uint64(_MULT)), start))


_CUT = StructType([StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])


@F.pandas_udf(_CUT)
def _remove(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, starts, counts in batches:
        rows = []
        for text, at, n in zip(texts, starts, counts):
            data = _encode(text)
            covered = np.zeros(len(data.split()) + 1, np.int64)
            if at is not None and len(at):
                np.add.at(covered, at, 1)
                np.add.at(covered, np.asarray(at) + np.asarray(n) + (WINDOW - 1), -1)
            rows.append(_kept(data, np.cumsum(covered)[:-1] > 0))
        yield pd.DataFrame(rows, columns=["n_removed", "kept_sha256"])


def _marked(looked: DataFrame) -> DataFrame:
    """(_row, at, n): runs of n windows, from word ``at``, that also start in a document
    with a smaller doc_id."""
    segment = (looked.where(F.size("at") > 0)
               .select("_row", "doc_id", "hash", F.explode(F.arrays_zip("seed", "segment", "at", "n", "first")).alias("s"))
               .select("_row", "doc_id", "s.seed", "s.segment", "s.at", "s.n",
                       F.slice("hash", F.col("s.first") + 1, F.col("s.n")).alias("hash")))
    # Written tables on the small side leave the joins to themselves: hot keys can be split.
    by_seed = materialize(
        segment.groupBy("seed").agg(F.min("segment").alias("_lo"), F.max("segment").alias("_hi"),
                                    F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max"))
        .where(F.col("_min") < F.col("_max")).select("seed", (F.col("_lo") == F.col("_hi")).alias("_same"), "_min"),
        "seed-segments")
    met = segment.join(by_seed, "seed")
    equal = met.where(F.col("_same") & (F.col("doc_id") > F.col("_min"))).select("_row", "at", "n")

    window = (met.where(~F.col("_same")).select("_row", "doc_id", "seed", "at", F.posexplode("hash").alias("k", "hash"))
              .select("_row", "doc_id", "seed", "hash", (F.col("at") + F.col("k")).alias("at")))
    firsts = materialize(
        window.groupBy("seed", "hash").agg(F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max"))
        .where(F.col("_min") < F.col("_max")).drop("_max"), "window-firsts")
    later = (window.join(firsts, ["seed", "hash"]).where(F.col("doc_id") > F.col("_min"))
             .select("_row", "at", F.lit(1).alias("n")))
    return equal.unionByName(later)


def _finish(looked: DataFrame) -> DataFrame:
    marked = _marked(looked).groupBy("_row").agg(F.collect_list(F.struct("at", "n")).alias("_m"))
    cut = (looked.where(F.size("at") > 0).select("_row", "doc_id", "n_words", "_t")
           .join(marked, "_row", "left")
           .select("doc_id", "n_words", _remove("_t", F.col("_m.at"), F.col("_m.n")).alias("r"))
           .select("doc_id", "n_words", "r.n_removed", "r.kept_sha256"))
    whole = looked.where(F.size("at") == 0).select(
        "doc_id", "n_words", F.when(F.col("gone"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        "kept_sha256")
    return cut.unionByName(whole)
