"""Packing token pieces into fixed windows by non-negative least squares.

A document's ids (with an end id) are cut into whole windows, each a sequence of
its own, and one remainder. The histogram of remainder lengths has at most window - 1
entries, so the plan is made on it alone and does not grow with the corpus:

* lengths are taken in groups, the most frequent with their complements first; all
  combinations of at most four lengths that fill the window exactly are enumerated,
  and non-negative least squares gives repeat counts that explain the group's
  histogram; the counts are rounded within what is there;
* what is left is packed greedily, length by length, looking one step ahead for an
  exact fill; a greedy sequence with more than ``max_gap`` empty places is not made:
* those pieces are laid end to end and cut at every window; the last, shorter stretch
  is cut into powers of two, which need no padding.

Tasks number the remainders of a length as they write them; counts by (task, length),
added up, make the numbers consecutive over all tasks, and a number names its place
in the plan. Texts are tokenized once and only remainders are joined.

Defined results: null and empty texts are the end id alone; repeated ids and texts
are separate rows, each with its own pieces; very long texts are encoded alone, memory grows
with the longest text; an empty table gives an empty result; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import os
import sys
import types
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharf.llm.common import ranges
from wharf.session import materialize

WINDOW = 2048
END_ID = 1
LENGTHS_PER_SOLVE = 64
#: About how many words a worker remembers with their ids.
CACHED_WORDS = 1_000_000
#: Bytes of the texts that are encoded at a time (a longer text is encoded alone).
_BLOCK = 1 << 22
_ENCODED = 500
_LONG_WORD = 64
_RANKS = 40


# --------------------------------------------------------------------------- plan

def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimizes |a x - b|, by active sets."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.zeros_like(x)
            s[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s[at].min() > 0:
                break
            low = at[s[at] <= 0]
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > tolerance
            x[~active] = 0
            if not active.any():
                s = np.zeros_like(x)
                break
        x = s
    return x


def combinations_filling(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Rising combinations of two to four of ``lengths`` (repeats allowed) with sum ``window``."""
    lengths = sorted(lengths)
    pairs: dict[int, list[tuple[int, int]]] = {}
    for i, a in enumerate(lengths):
        for b in lengths[i:]:
            pairs.setdefault(a + b, []).append((a, b))
    out = list(pairs.get(window, []))
    for c in lengths:
        out += [(a, b, c) for a, b in pairs.get(window - c, []) if b <= c]
    for total, small in pairs.items():
        for c, d in pairs.get(window - total, []):
            out += [(a, b, c, d) for a, b in small if b <= c]
    return out


def _solve_group(group: list[int], left: Counter, window: int) -> list[tuple[tuple[int, ...], int]]:
    combos = combinations_filling(group, window)
    if not combos:
        return []
    row = {v: i for i, v in enumerate(group)}
    a = np.zeros((len(group), len(combos)))
    for j, combo in enumerate(combos):
        for v in combo:
            a[row[v], j] += 1
    x = nnls(a, np.array([left[v] for v in group], dtype=float))
    out = []
    for j in np.argsort(-x, kind="stable"):
        need = Counter(combos[j])
        n = min(int(x[j] + 0.5), *(left[v] // m for v, m in need.items()))
        if n > 0:
            out.append((combos[j], n))
            for v, m in need.items():
                left[v] -= n * m
    return out


def make_plan(histogram: dict[int, int], window: int = WINDOW, max_gap: int = 0,
              lengths_per_solve: int = LENGTHS_PER_SOLVE) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(lengths of a sequence, number of such sequences) and the pieces to lay end to end."""
    left = Counter({v: n for v, n in histogram.items() if n > 0})
    order = sorted(left, key=lambda v: (-left[v], v))
    patterns, taken = [], set()
    while len(taken) < len(order):
        group: list[int] = []
        for v in order:
            for u in (v, window - v):
                if u in left and u not in taken and len(group) < lengths_per_solve:
                    group.append(u)
                    taken.add(u)
        patterns += _solve_group(group, left, window)

    counts = np.zeros(window + 1, dtype=np.int64)
    for v, n in left.items():
        counts[v] = n
    loose: dict[int, int] = {}
    while counts.any():
        first = int(np.flatnonzero(counts)[-1])
        use, free = Counter([first]), window - first
        while free:
            have = counts[:free + 1].copy()
            for v, m in use.items():
                if v <= free:
                    have[v] -= m
            some = np.flatnonzero(have > 0)
            if not len(some):
                break
            exact = some[(some == free) | (have[free - some] > (2 * some == free))]
            v = int(exact[-1]) if len(exact) else int(some[-1])
            use[v] += 1
            free -= v
        if free > max_gap:
            loose[first] = int(counts[first])
            counts[first] = 0
            continue
        n = min(int(counts[v]) // m for v, m in use.items())
        patterns.append((tuple(sorted(use.elements())), n))
        for v, m in use.items():
            counts[v] -= n * m
    return patterns, loose


class Places:
    """Where the k-th remainder of a length goes: arrays of the size of the plan."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], loose: dict[int, int], window: int):
        used: Counter = Counter()
        rows, sequence = [], 0
        for lengths, n in patterns:
            offset = 0
            for v, m in sorted(Counter(lengths).items()):
                rows.append((v, used[v], m, sequence, offset, 0))
                used[v] += m * n
                offset += m * v
            sequence += n
        at = 0
        for v, n in sorted(loose.items()):
            rows.append((v, used[v], 1, 0, at, 1))
            at += v * n
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 6)
        self.key = (table[:, 0] << _RANKS) + table[:, 1]
        self.first, self.many, self.sequence, self.offset, self.laid = table[:, 1:].T
        # Cuts of the laid pieces: every window, then powers of two of the rest.
        self.window, self.base, self.whole = window, sequence, at // window
        edge, tail = self.whole * window, []
        for bit in range(window.bit_length() - 1, -1, -1):
            if (at % window) >> bit & 1:
                tail.append(edge)
                edge += 1 << bit
        self.tail = tail + [edge]
        self.sequences = sequence + self.whole + len(tail)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, laid) of remainders; for laid ones offset is the place on the line."""
        row = np.searchsorted(self.key, (length << _RANKS) + rank, "right") - 1
        k = rank - self.first[row]
        laid = self.laid[row] == 1
        sequence = self.sequence[row] + np.where(laid, 0, k // self.many[row])
        return sequence, self.offset[row] + np.where(laid, k, k % self.many[row]) * length, laid

    def cut(self, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the parts of a laid piece."""
        at, end, line = place, place + length, self.whole * self.window
        while at < end:
            if at < line:
                s = at // self.window
                low, high = s * self.window, (s + 1) * self.window
            else:
                t = int(np.searchsorted(self.tail, at, "right")) - 1
                s, low, high = self.whole + t, self.tail[t], self.tail[t + 1]
            stop = min(end, high)
            yield at - place, stop - at, self.base + s, at - low
            at = stop


# --------------------------------------------------------------------------- Spark

def _worker_state() -> dict:
    """Lives as long as the Python worker, over its tasks: functions travel by value, their globals don't."""
    return sys.modules.setdefault("_wharf_packing", types.ModuleType("_wharf_packing")).__dict__


def _encoder(path: str, by_words: bool):
    """A function from words to their ids (little-endian bytes)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    state = _worker_state()
    if state.get("path") != (path, by_words):
        state.update(path=(path, by_words), tokenizer=Tokenizer.from_file(path), known={})
    tokenizer, known = state["tokenizer"], state["known"]
    special = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]

    # Where the vocabulary's own rules leave lower-case letters as they are, these go to its model at once.
    kept = by_words and tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str("word"))
    plain = kept == [("word", (0, 4))]

    def ids_of(parts: list[bytes]) -> dict[bytes, bytes]:
        out, rest = {}, []
        for p in parts:
            if plain and p.isalpha() and p.isascii() and p.islower():
                out[p] = array("I", [t.id for t in tokenizer.model.tokenize(p.decode())]).tobytes()
            else:
                rest.append(p)
        for at in range(0, len(rest), _ENCODED):
            some = rest[at:at + _ENCODED]
            got = tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in some], add_special_tokens=False)
            out.update((p, array("I", e.ids).tobytes()) for p, e in zip(some, got))
        return out

    def parts_of(word: bytes) -> tuple[bytes, ...]:
        """The word without case (ASCII alone) and closing punctuation, which is a token run of its own."""
        low = word.lower()
        if any(s in low for s in special):
            return (word,)
        stem = low.rstrip(b".,;:!?")
        if not low.isascii():
            low, stem = word, word[:len(stem)]
        return (stem, low[len(stem):]) if len(stem) < len(low) and stem[-1:].isalnum() else (low,)

    def encode(words: list[bytes]) -> list[bytes]:
        """Ids of different words (or, not ``by_words``, of texts)."""
        if not by_words:
            return list(map(ids_of(words).__getitem__, words))
        new = {w: parts_of(w) for w in set(words).difference(known)}
        parts = list({p for own in new.values() for p in own}.difference(known))
        known.update(ids_of(parts))
        for w, own in new.items():
            if w not in known:
                known[w] = known[own[0]] if len(own) == 1 else known[own[0]] + known[own[1]]
        out = list(map(known.__getitem__, words))
        full = len(known) > CACHED_WORDS
        for w in [w for w in {*new, *parts} if full or len(w) > _LONG_WORD]:
            del known[w]
        return out

    return encode


def _encode_texts(texts: pa.Array, encode, by_words: bool) -> list[bytes]:
    """Ids of each text. No token spans white space, so each different word is encoded once."""
    words = pc.ascii_split_whitespace(texts) if by_words else pa.array([[t] for t in texts.to_pylist()],
                                                                       pa.list_(pa.string()))
    coded = words.flatten().dictionary_encode()
    ids = encode(coded.dictionary.cast(pa.binary()).to_pylist())
    data = np.frombuffer(b"".join(ids), dtype="<u4")
    sizes = np.array([len(i) // 4 for i in ids], dtype=np.int64)
    word = coded.indices.to_numpy()
    own = sizes[word]
    tokens = data[ranges((np.cumsum(sizes) - sizes)[word], own)]
    edges = np.concatenate([[0], np.cumsum(own)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
    return [tokens[a:b].tobytes() for a, b in zip(edges, edges[1:])]


_PIECES = "doc_tokens long, start long, length long, ids binary, part int, rank long"


def _tokenize(path: str, window: int, end_id: int, by_words: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(path, by_words), TaskContext.get().partitionId(), Counter()

        def pieces(owner: int, ids: bytes) -> Iterator[tuple]:
            total = len(ids) // 4
            for at in range(0, total, window):
                length = min(window, total - at)
                yield owner, total, at, length, ids[4 * at:4 * (at + length)], part, seen[length]
                seen[length] += 1

        for batch in batches:
            texts, at = pc.fill_null(batch.column("text"), ""), 0
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            while at < len(batch):
                done = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
                rows = []
                for k, ids in enumerate(_encode_texts(texts.slice(at, stop - at), encode, by_words), at):
                    rows += pieces(k, ids + end)
                at = stop
                owner, *columns = (list(c) for c in zip(*rows))
                types = [pa.int64()] * 3 + [pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner)), *[pa.array(c, t) for c, t in zip(columns, types)]],
                    names=["doc_id", "doc_tokens", "start", "length", "ids", "part", "rank"])
    return run


def _place(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            sequence, offset, laid = places.find(length, rank)
            alone = np.flatnonzero(~laid)
            out = [(i, int(start[i]), int(length[i]), 0, int(sequence[i]), int(offset[i])) for i in alone.tolist()]
            for i in np.flatnonzero(laid).tolist():
                out += [(i, int(start[i]) + a, n, a, s, o) for a, n, s, o in places.cut(int(offset[i]), int(length[i]))]
            owner = pa.array([r[0] for r in out], pa.int64())
            ids = batch.column("ids")
            cut = [ids[i].as_py()[4 * a:4 * (a + n)] for i, _, n, a, _, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(owner), batch.column("doc_tokens").take(owner),
                 *[pa.array([r[c] for r in out], pa.int64()) for c in (1, 2)], pa.array(cut, pa.binary()),
                 *[pa.array([r[c] for r in out], pa.int64()) for c in (4, 5)]],
                names=["doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, max_gap: int = 0,
         by_words: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, doc_tokens, start, length, ids (binary, little-endian
    unsigned 32 bits), sequence_id and offset. ``tokenizer``: path of a vocabulary file.

    ``by_words`` is for vocabularies that drop white space, lower-case and separate closing
    punctuation: words are encoded once a worker. Otherwise each text is encoded as a whole.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    pieces = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                         .mapInArrow(_tokenize(tokenizer, window, end_id, by_words), f"doc_id {key}, {_PIECES}"),
                         "pieces", "zstd")
    counts = materialize(pieces.where(F.col("length") < window).groupBy("part", "length")
                         .agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(*make_plan(histogram, window, max_gap), window)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbered = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    rest = (pieces.where(F.col("length") < window).join(numbered, ["part", "length"])
            .select("doc_id", "doc_tokens", "start", "length", "ids", (F.col("rank") + F.col("before")).alias("rank"))
            .mapInArrow(_place(places), f"doc_id {key}, doc_tokens long, start long, length long, ids binary, "
                                        "sequence_id long, offset long"))
    # A whole window is its own sequence, numbered by task and place in the task.
    whole = pieces.where(F.col("length") == window).select(
        "doc_id", "doc_tokens", "start", "length", "ids",
        (F.lit(places.sequences) + F.shiftleft(F.col("part").cast("long"), 33) + F.col("rank")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return rest.unionByName(whole)
