"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - weights . features): one weight per
hashed feature, shared by all grades, and ordered thresholds. Features are
hashed character n-grams of the whole text, log-scaled and of unit length. The
expected grade ranks documents; the tail probability P(grade >= keep_grade)
selects them.

Defined results: null text counts as empty; an empty text has no features and
gets the thresholds' own probabilities; without labelled rows of two grades every
document gets the one grade there is (0 without any); equal texts score alike; an
empty table gives an empty result. doc_id only decides which rows are held out;
lang, source, n_chars and labels are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.llm.common import text_of
from wharf.llm.hashed_text import Hasher, held_out, labelled_sample

ORDERS = (2, 3)
BITS = 14
SAMPLE_ROWS = 6_000


def rating() -> Column:
    """Graded rating of the labels table: 0 poor, 1 good but toxic, 2 good."""
    return F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))


def _features(hasher: Hasher, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    counts = hasher.counts(text)
    ids = np.flatnonzero(counts)
    value = np.log1p(counts[ids])
    return ids, value / (np.sqrt((value * value).sum()) or 1.0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_ordinal(y: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int,
                grades: int, l2: float = 1e-5, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the whole sample.

    Thresholds are the first one plus exponentials of free steps, so they stay
    ordered at every step.
    """
    cut = np.clip([np.mean(y <= k) for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.log(cut / (1 - cut))
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, steps = p[:width], np.exp(p[width + 1:])
        theta = p[width] + np.concatenate([[0.0], np.cumsum(steps)])
        z = np.bincount(row, value * w[col], len(y))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(invalid="ignore"):
            hi, lo = _sigmoid(bounds[y + 1] - z), _sigmoid(bounds[y] - z)
        hi, lo = np.where(y == grades - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
        like = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        g_z = d_hi - d_lo                                     # of -log likelihood
        g_theta = np.array([(-(d_hi * (y == k)) + d_lo * (y == k + 1)).mean() for k in range(grades - 1)])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, value * g_z[row], width) / len(y) + l2 * w, tail[:1],
                            tail[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-10)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1:]))])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights, and the thresholds between grades 0..K (one row each, bounded)."""
    sample = labelled_sample(docs, labels, rating(), max_rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(ORDERS, BITS)
        for pdf in batches:
            found = [_features(hasher, t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "k": pdf["k"], "ids": [i for i, _ in found], "x": [x for _, x in found]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "k"])
        y = pdf["y"].to_numpy(int)
        if len(np.unique(y)) < 2:  # -1: the only grade
            return pd.DataFrame({"id": [-1], "weight": [float(y[0])]})
        row = np.repeat(np.arange(len(pdf)), [len(i) for i in pdf["ids"]])
        w, theta = fit_ordinal(y, row, np.concatenate(list(pdf["ids"])).astype(np.int64),
                               np.concatenate(list(pdf["x"])), 1 << BITS, int(y.max()) + 1)
        return pd.DataFrame({"id": np.concatenate([np.arange(1 << BITS), -2 - np.arange(len(theta))]),
                             "weight": np.concatenate([w, theta])})

    # Texts are hashed in parallel; the one task that fits gets at most 2**BITS values of a row.
    hashed = sample.withColumn("k", F.xxhash64("text")).mapInPandas(features, "y int, k long, ids array<long>, x array<double>")
    got = hashed.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "id long, weight double").toPandas()
    weights, theta = np.zeros(1 << BITS), got[got["id"] <= -2].sort_values("id", ascending=False)["weight"].to_numpy()
    some = got[got["id"] >= 0]
    weights[some["id"].to_numpy()] = some["weight"].to_numpy()
    if not len(theta):
        only = int(got["weight"].iloc[0]) if len(got) else 0
        theta = np.full(only, -40.0)  # every grade below the only one is ruled out
    return weights, theta


def score_quality(docs: DataFrame, labels: DataFrame, keep_grade: int = 1, least: float = 0.5,
                  max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))

    @F.pandas_udf("expected_grade double, tail_probability double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        (weights, theta), hasher = shared.value, Hasher(ORDERS, BITS)
        for texts in batches:
            z = np.array([float(weights[i] @ x) for i, x in (_features(hasher, t) for t in texts)])
            above = 1 - _sigmoid(theta[None, :] - z.reshape(-1, 1))  # P(grade > k)
            tail = (above[:, keep_grade - 1] if keep_grade <= len(theta) else np.zeros(len(z))) if keep_grade else np.ones(len(z))
            yield pd.DataFrame({"expected_grade": above.sum(axis=1), "tail_probability": tail})

    out = docs.select("doc_id", held_out().alias("held_out"), grade(text_of()).alias("g"))
    return out.select("doc_id", "held_out", "g.expected_grade", "g.tail_probability",
                      (F.col("g.tail_probability") >= least).alias("kept"))
