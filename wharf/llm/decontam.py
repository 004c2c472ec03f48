"""Benchmark decontamination by greedy string tiling.

Seeds: runs of ``seed`` words (lower-cased ``\\w+``) that a benchmark item and a
document share. Items come in shards of a bounded number of words; a shard's
seed index is what is broadcast, and more items mean more shards, so the bound
holds for a benchmark of any size. Documents are streamed past each shard whole;
with several shards a pass is written before the next one starts, so that one
broadcast is held at a time. Items whose seeds cover too little of them go before
any tiling, and items that look alike outside their unshared words are tiled once,
so a seed that thousands of items share costs a document little more than one item.
For an item whose seeds cover enough of it, tiling repeatedly finds the longest
match between the unmarked words of both sides (running Karp-Rabin hashes, word
by word verification), marks it, and goes on down to the seed length. The share
of the item's words that lie in tiles is its coverage; the order of the tiles
does not matter, so reordered passages count in full.

Defined results: null text counts as empty and matches nothing; items with fewer
words than a seed never match; equal items each give their own row; repeated
documents each give their rows; an empty table on either side gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wharf.llm.common import delete, ranges, text_of
from wharf.session import materialize, scratch_path

SEED = 5
THRESHOLD = 0.5
SHARD_WORDS = 2_000_000
#: This many characters weigh as much as a word, so that long words bound a shard as well.
WORD_CHARS = 8

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of n ids, in log n steps."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out, width, power = ids, 1, _BASE
    with np.errstate(over="ignore"):
        # Powers of two first, then two overlapping halves.
        while width * 2 <= n:
            out = out[:len(out) - width] * power + out[width:]
            width, power = width * 2, power * power
        if width < n:
            out = (out[:len(ids) - n + 1] * np.uint64(0xD6E8FEB86659FD93)) ^ out[n - width:]
    return out


def _common(p: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Starts in t of runs of n unmarked ids that occur unmarked in p."""
    hp, ht = rolling(p, n), rolling(t, n)
    ok_p = _clean(p, n)
    return np.flatnonzero(_clean(t, n) & np.isin(ht, hp[ok_p]))


def _clean(ids: np.ndarray, n: int) -> np.ndarray:
    """Runs of n without a marked word (marked words are 0)."""
    bad = np.concatenate([[0], np.cumsum(ids == 0)])
    return bad[n:] == bad[:len(bad) - n]


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> int:
    """Words of ``item`` that lie in greedy string tiles with ``text``.

    Ids are positive; 0 is a word that matches nothing. Longest matches are
    marked first; among equally long ones, those earlier in the text.
    """
    p, t = item.copy(), text.copy()
    longest = min(len(p), len(t))
    while longest >= least:
        lo, hi = least - 1, longest           # longest common run of unmarked words
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(_common(p, t, mid)) else (lo, mid - 1)
        if lo < least:
            break
        marked, places = (p == 0).sum(), defaultdict(list)
        hp = rolling(p, lo)
        for i in np.flatnonzero(_clean(p, lo)):
            places[hp[i]].append(i)
        ht = rolling(t, lo)
        for j in _common(p, t, lo):
            if (t[j:j + lo] == 0).any():
                continue
            for i in places[ht[j]]:
                if (p[i:i + lo] != 0).all() and (p[i:i + lo] == t[j:j + lo]).all():
                    p[i:i + lo] = t[j:j + lo] = 0
                    break
        longest = lo if (p == 0).sum() > marked else lo - 1
    return int((p == 0).sum() - (item == 0).sum())


class Shard:
    """Seed index of some items: word ids, seed hashes (sorted) and where they stand."""

    def __init__(self, items: list[tuple], seed: int):
        self.seed, self.vocabulary, self.ids, self.items = seed, {}, [], [i for i, _ in items]
        for _, text in items:
            self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                                      for w in words(text)], dtype=np.uint64))
        found = [(rolling(w, seed), k) for k, w in enumerate(self.ids)]
        hashes = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)])
        item = np.concatenate([np.full(len(h), k) for h, k in found] or [np.zeros(0, np.int64)])
        place = np.concatenate([np.arange(len(h)) for h, _ in found] or [np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order].astype(np.int64), place[order]
        self.size = np.array([len(w) for w in self.ids], np.int64)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, parts: dict) -> Shard:
        """A shard from ``vars`` of one: what is broadcast is plain data."""
        shard = cls.__new__(cls)
        shard.__dict__.update(parts)
        return shard

    def matches(self, text: str | None, threshold: float) -> Iterator[tuple]:
        """(item id, covered words, words of the item) for items at or above the threshold."""
        get = self.vocabulary.get
        t = np.array([get(w, 0) for w in words(text)], dtype=np.uint64)
        h = rolling(t, self.seed)
        at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)] & _clean(t, self.seed)) \
            if len(h) else np.zeros(0, np.int64)
        if not len(at):
            return
        lo, hi = np.searchsorted(self.hashes, h[at]), np.searchsorted(self.hashes, h[at], "right")
        at = at[hi > lo]
        if not len(at):
            return
        # Only words inside seeds can lie in tiles; gaps become one word that matches nothing.
        inside = np.zeros(len(t) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + self.seed, -1)
        inside = np.cumsum(inside)[:-1] > 0
        short = np.where(inside, t, np.uint64(0))
        short = short[inside | np.concatenate([[False], inside[:-1]])]
        tiled: dict[bytes, int] = {}
        for k, shared in self._covered(np.unique(h[at]), threshold):
            n, key = len(self.ids[k]), shared.tobytes()
            if key not in tiled:
                tiled[key] = tile(shared, short, self.seed)
            if tiled[key] >= threshold * n:
                yield self.items[k], tiled[key], n

    def _covered(self, hashes: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """Items that these seeds cover up to the threshold, as no tiling can cover more than
        its seeds do, with their words; a gap between seeds is one word that matches nothing."""
        lo, hi = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
        at = ranges(lo, hi - lo)
        at = at[np.lexsort((self.place[at], self.item[at]))]
        item, place = self.item[at], self.place[at]
        new = np.concatenate([[True], item[1:] != item[:-1]])
        step = np.where(new, self.seed, np.minimum(np.diff(place, prepend=0), self.seed))
        start = np.flatnonzero(new)
        enough = np.add.reduceat(step, start) >= threshold * self.size[item[start]]
        for a, b in zip(start[enough].tolist(), np.append(start, len(at))[1:][enough].tolist()):
            inside = np.zeros(int(place[b - 1] - place[a]) + self.seed + 1, np.int64)
            inside[place[a:b] - place[a]] += 1
            inside[place[a:b] - place[a] + self.seed] -= 1
            inside = np.cumsum(inside)[:-1] > 0
            words_ = np.where(inside, self.ids[item[a]][place[a]:place[a] + len(inside)], np.uint64(0))
            yield int(item[a]), words_[inside | np.concatenate([[False], inside[:-1]])]


@F.pandas_udf(LongType())
def _weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Words as the operator sees them, or characters / WORD_CHARS where that is more."""
    for texts in batches:
        yield pd.Series([max(1, len(words(t)), -(-len(t) // WORD_CHARS)) for t in texts], dtype="int64")


def _shards(benchmark: DataFrame, shard_words: int) -> tuple[DataFrame, int]:
    """Items (as rows) with a shard number: at most about ``shard_words`` words (and
    ``WORD_CHARS`` times as many characters) each, but for an item that is longer by itself."""
    items = materialize(benchmark.select("item_id", text_of().alias("text"))
                        .withColumn("n", _weight("text")), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    return items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), shards


def _shard_index(benchmark: DataFrame, seed: int, shard_words: int) -> Iterator[tuple]:
    """(broadcast index, whether it is the last): an index is destroyed before the next is made."""
    items, shards = _shards(benchmark, shard_words)
    for s in range(shards):
        rows = items.where(F.col("shard") == s).select("item_id", "text").orderBy("item_id", "text").collect()
        index = benchmark.sparkSession.sparkContext.broadcast(vars(Shard([tuple(r) for r in rows], seed)))
        yield index, s == shards - 1
        if s < shards - 1:
            index.destroy()


def find_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD,
                      shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document and item at or above the threshold: doc_id, item_id,
    covered_words, item_words, coverage."""
    out = None
    for index, last in _shard_index(benchmark, seed, shard_words):
        hits = _matching(index, threshold, benchmark.schema["item_id"].dataType.simpleString())(text_of())
        part = docs.select("doc_id", F.explode(F.arrays_zip(hits["item_id"], hits["covered"], hits["words"])).alias("m"))
        part = part.select("doc_id", "m.item_id", F.col("m.covered").alias("covered_words"),
                           F.col("m.words").alias("item_words"))
        part = part if last else materialize(part, "shard-hits")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def _matching(index, threshold: float, item_type: str):
    """UDF from whole text to the items of one shard that it covers."""
    @F.pandas_udf(f"item_id array<{item_type}>, covered array<long>, words array<long>")
    def matching(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shard = Shard.of(index.value)
        for texts in batches:
            found = [list(shard.matches(t, threshold)) for t in texts]
            yield pd.DataFrame({"item_id": [[m[0] for m in f] for f in found],
                                "covered": [[m[1] for m in f] for f in found],
                                "words": [[m[2] for m in f] for f in found]})
    return matching


def _clean_of(index, threshold: float):
    """UDF from whole text to whether it covers no item of one shard."""
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shard = Shard.of(index.value)
        for texts in batches:
            yield pd.Series([next(shard.matches(t, threshold), None) is None for t in texts], dtype=bool)
    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD,
                      shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (all columns) without documents that cover an item: a filter per shard.

    With several shards each pass but the last is written; of these tables the newest stays.
    """
    spark, before = docs.sparkSession, None
    for index, last in _shard_index(benchmark, seed, shard_words):
        docs = docs.where(_clean_of(index, threshold)(text_of()))
        if not last:
            path = scratch_path(spark, "shard-rest")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs
