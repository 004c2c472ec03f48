"""Hashed character n-grams of whole texts, in bounded memory, and the bounded
labelled sample that the classifiers are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharf.llm.common import text_of
from wharf.session import materialize

#: Texts are hashed in pieces of this many characters, so a long one needs no more memory.
PIECE = 1 << 18


class Hasher:
    """Ids below 2**bits of the n-grams (of the given lengths) of a text's characters."""

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits = orders, bits
        self._seen = np.zeros(1 << bits, dtype=bool)

    def _pieces(self, text: str | None):
        data = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), np.uint32)
        longest = max(self.orders)
        for at in range(0, len(data), PIECE):
            b = data[at:at + PIECE + longest - 1]
            starts = min(PIECE, len(data) - at)
            h = b
            for n in range(2, longest + 1):
                if len(h) < 2:
                    break
                h = h[:-1] * np.uint32(0x01000193) + b[n - 1:]
                if n in self.orders:
                    mixed = (h[:starts] ^ (h[:starts] >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
                    yield mixed >> np.uint32(32 - self.bits)

    def present(self, text: str | None, among: np.ndarray | None = None) -> np.ndarray:
        """Sorted ids that occur; with ``among``, a flag per id, only those."""
        if among is not None:
            found = [ids[among[ids]] for ids in self._pieces(text)]
            return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)
        for ids in self._pieces(text):
            self._seen[ids] = True
        out = np.flatnonzero(self._seen)
        self._seen[out] = False
        return out

    def counts(self, text: str | None) -> np.ndarray:
        """How often each id occurs."""
        out = np.zeros(1 << self.bits, dtype=np.int64)
        for ids in self._pieces(text):
            out += np.bincount(ids, minlength=1 << self.bits)
        return out


def held_out():
    """True for the rows that no classifier learns from: crc32 of doc_id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, grade, max_rows: int) -> DataFrame:
    """(y, text) of at most ``max_rows`` labelled rows, chosen by a hash of doc_id.

    ``grade`` is a column of ``labels``. Held-out rows and rows without a grade
    are left out. The chosen ids (at most ``max_rows``) are what is broadcast; of rows
    that repeat an id the text with the smallest hash is taken.
    """
    ids = (labels.select("doc_id", grade.cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(~held_out())
           .groupBy("doc_id").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    chosen = (docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")
              .groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")))
    return materialize(chosen.select("y", "t.text"), "labelled-sample")
