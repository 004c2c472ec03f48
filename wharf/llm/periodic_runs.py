"""Periodic runs of words by an enhanced suffix array and the branching-tandem test.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words
that no neighbouring word extends. Documents are independent, so Spark only maps
over them; each task works on chunks of whole documents with numpy:

* Words of a run of four periods stand in 4-grams that repeat; stretches where none
  does are left out first (exact, repeated while it shrinks the chunk).
* Prefix doubling ranks the rest; the ranks of every level give the suffix array,
  its inverse (ISA) and the LCP array, and later compare two places in log time.
* Each LCP interval of depth d is a pair of borders in the suffix array, no tree
  node. Suffixes i of all children but the largest check that ISA[i + d] or
  ISA[i - d] lies in the interval: then i (or i - d) starts a square of period d. If
  another word follows its second half than follows its first, it is branching, the
  last square of its run.
* Squares are rotated to the left as long as they stay squares, which gives the run;
  of runs over the same words the smallest period is kept.

Defined results: null and empty texts have no words and no runs; equal texts and
repeated ids are separate rows; very long texts are chunks of their own, memory grows
with the longest text; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharf.llm.common import ranges

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words of one chunk of documents; a longer document is a chunk of its own.
CHUNK_WORDS = 400_000
_GRAM = 4
_EXPANDED = 1 << 21


def _codes(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0].astype(np.int64)


def _narrow(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (starts, lengths) in which every 4-gram repeats within its old stretch."""
    at = ranges(starts, lengths)
    seg = np.repeat(np.arange(len(starts)), lengths)
    if len(at) < _GRAM:
        return starts[:0], lengths[:0]
    w = codes[at]
    two = _codes(w[:-1] * (int(w.max()) + 1) + w[1:])
    four = _codes(two[:-2] * (int(two.max()) + 1) + two[2:])
    own = _codes(four * len(starts) + seg[:len(four)])
    inside = seg[:len(own)] == seg[_GRAM - 1:]
    again = np.zeros(len(own) + 2, dtype=np.int8)
    again[1:-1] = inside & (np.bincount(own[inside], minlength=int(own.max()) + 1)[own] > 1)
    # A stretch ends where a 4-gram is single or the old stretch ends.
    edges = np.diff(again)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = last - first >= LEAST_WORDS - _GRAM + 1
    return at[first[keep]], (last - first)[keep] + _GRAM - 1


def _levels(rank: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 2^k words of every suffix, for k = 0, 1, ..; the last are all different."""
    out, step, n = [rank], 1, len(rank)
    while int(out[-1].max()) + 1 < n:
        last = out[-1].astype(np.int64)
        after = np.zeros(n, dtype=np.int64)
        after[:n - step] = last[step:] + 1
        out.append(np.unique(last * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        step *= 2
    return out


def _lcp(levels: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """lcp[j]: common words of suffixes sa[j - 1] and sa[j]; 0 at both ends."""
    a, b = sa[:-1], sa[1:]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 2, -1, -1):
        common += (levels[k][a + common] == levels[k][b + common]).astype(np.int64) << k
    return np.concatenate([[0], common, [0]])


def _neighbours(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest indices before and after ``at`` whose value is at most lcp[at]."""
    zeros = np.flatnonzero(lcp == 0)
    longest = int(np.diff(zeros).max())
    low, v = [lcp], lcp[at]
    while 2 << (len(low) - 1) <= longest:                      # minima of 2^k neighbours
        half = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
    after, before = at + 1, at.copy()
    for k in range(len(low) - 1, -1, -1):
        m, size = low[k], 1 << k
        ok = (after < len(m)) & (m[np.minimum(after, len(m) - 1)] > v)
        after = after + (ok.astype(np.int64) << k)
        ok = (before >= size) & (m[np.maximum(before - size, 0)] > v)
        before = before - (ok.astype(np.int64) << k)
    return before - 1, after


def _squares(rank: np.ndarray, sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching square."""
    border = np.flatnonzero(lcp > 0)
    if not len(border):
        return border, border
    before, after = _neighbours(lcp, border)
    depth = lcp[border]
    first = lcp[before] < depth                                # the first border of its interval
    order = np.argsort(depth, kind="stable")
    group = np.empty(len(border), dtype=np.int64)
    group[order] = np.cumsum(first[order]) - 1                 # borders of one interval follow each other
    n = int(first.sum())
    lo, hi, size = (np.zeros(n, dtype=np.int64) for _ in range(3))
    lo[group[first]] = before[first]
    size[group[first]] = depth[first]
    np.maximum.at(hi, group, after - 1)
    # Children: right of each border, and left of the first one.
    child_lo = np.concatenate([border, before[first]])
    child_hi = np.concatenate([after - 1, border[first] - 1])
    parent = np.concatenate([group, group[first]])
    width = child_hi - child_lo + 1
    by_size = np.lexsort((width, parent))
    largest = np.append(np.diff(parent[by_size]) != 0, True)
    small = by_size[~largest]
    starts, periods = [], []
    ends = np.cumsum(width[small])
    at = 0
    while at < len(small):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _EXPANDED, "right")))
        part = small[at:stop]
        i = sa[ranges(child_lo[part], width[part])]
        g = np.repeat(parent[part], width[part])
        d, a, b = size[g], lo[g], hi[g]
        for shift in (0, 1):                                   # the square starts at i, or at i - d
            s = i - d if shift else i
            ok = (s >= 0) & (s + d < len(sa))
            s, dd = s[ok], d[ok]
            other = isa[s] if shift else isa[s + dd]
            ok = (other >= a[ok]) & (other <= b[ok])
            s, dd = s[ok], dd[ok]
            ok = rank[s + dd] != rank[s + 2 * dd]
            starts.append(s[ok])
            periods.append(dd[ok])
        at = stop
    return np.concatenate(starts), np.concatenate(periods)


def _runs(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of the stretches, as rows, by places in ``codes``."""
    while len(starts):
        total = int(lengths.sum())
        starts, lengths = _narrow(codes, starts, lengths)
        if not len(starts) or lengths.sum() > 0.9 * total:
            break
    if not len(starts):
        return np.zeros((0, 3), dtype=np.int64)
    # The stretches one after another, each with an end mark of its own; words of
    # different stretches are different.
    marks = np.cumsum(lengths + 1) - 1
    seg = np.repeat(np.arange(len(starts)), lengths + 1)
    origin = ranges(starts, lengths + 1)
    word = codes[np.minimum(origin, len(codes) - 1)]
    word[marks] = int(codes.max()) + 1
    rank = np.unique(seg * (int(word.max()) + 1) + word, return_inverse=True)[1].astype(np.int32)
    levels = _levels(rank)
    isa = levels[-1].astype(np.int64)
    sa = np.empty(len(isa), dtype=np.int64)
    sa[isa] = np.arange(len(isa))
    lcp = _lcp(levels, sa)
    s, d = _squares(rank, sa, isa, lcp)
    end = s + 2 * d
    for k in range(len(levels) - 2, -1, -1):                   # rotate to the left
        back = s - (1 << k)
        ok = (back >= 0) & (levels[k][np.maximum(back, 0)] == levels[k][np.maximum(back + d, 0)])
        s = np.where(ok, back, s)
    length = end - s
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d)
    s, length, d = s[long], length[long], d[long]
    order = np.lexsort((d, length, s))
    s, length, d = s[order], length[order], d[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (length[1:] != length[:-1])
    return np.stack([origin[s[new]], length[new], d[new]], axis=1)


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not sizes.sum():
        return out
    codes = _codes(np.array([w for d in documents for w in d], dtype=object))
    offset = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    found = _runs(codes, offset[some], sizes[some])
    doc = some[np.searchsorted(offset[some], found[:, 0], "right") - 1]
    for i, (start, length, period) in zip(doc.tolist(), found.tolist()):
        out[i].append((start - int(offset[i]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between, without those behind the first period of a run."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, c in zip(words, np.cumsum(change)) if not c]
    return b" ".join(words)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, then smallest start, then period."""
    best = None
    for r in runs:                                             # in the order of start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _as_run(r: tuple[int, int, int] | None) -> dict | None:
    return None if r is None else {"start": r[0], "length": r[1], "period": r[2]}


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        at = 0
        while at < len(batch):
            documents, size, first = [], 0, at
            while at < len(batch) and (not documents or size < CHUNK_WORDS):
                documents.append((texts[at].as_py() or b"").split())
                size += len(documents[-1])
                at += 1
            found = runs_of(documents)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, len(documents)),
                pa.array([len(d) for d in documents], pa.int64()),
                pa.array([[_as_run(r) for r in runs] for runs in found], pa.list_(_RUN)),
                pa.array([_as_run(strongest(runs)) for runs in found], _RUN),
                pa.array([collapse(d, runs) for d, runs in zip(documents, found)], pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])


def find_periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, the strongest run and the collapsed text of every document."""
    key = docs.schema["doc_id"].dataType.simpleString()
    run = "struct<start: long, length: long, period: long>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _search, f"doc_id {key}, n_words long, runs array<{run}>, strongest {run}, collapsed string")
