"""Toxicity: a linear classifier on character n-grams, each feature scaled by
its naive Bayes log-count ratio.

The presence of hashed 4- to 6-grams in a whole text makes its features. Over a
bounded, hash-chosen sample of labelled rows (``SAMPLE_ROWS``) Spark sums per
feature how many toxic and clean rows hold it; the ratios come from those sums.
A logistic regression is then fitted on the scaled features of the same sample.
The model is 2**BITS weights, whatever the data; scoring is one pass.

Defined results: null text counts as empty; an empty text scores by the
intercept; without labelled rows of both kinds every score is the share of toxic
labels (0 where there are none); equal texts score alike; an empty table gives
an empty result. lang, source, n_chars, doc_id and labels are never inputs of a
score; doc_id only decides which rows are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharf.llm.common import text_of
from wharf.llm.hashed_text import Hasher, held_out, labelled_sample
from wharf.session import materialize

ORDERS = (4, 5, 6)
BITS = 20
SAMPLE_ROWS = 12_000
#: Features below this log-count ratio carry next to nothing and are left out.
LEAST_RATIO = 1.0
#: Added counts, by class share: a feature of a few rows tells little.
SMOOTH = 20.0


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: rows of each class that hold each feature."""
    hasher, held, rows = Hasher(ORDERS, BITS), np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for pdf in batches:
        for y, text in zip(pdf["y"], pdf["text"]):
            held[y, hasher.present(text)] += 1
            rows[y] += 1
    some = np.flatnonzero(held.any(axis=0))
    yield pd.DataFrame({"id": np.append(some, -1), "clean": np.append(held[0, some], rows[0]),
                        "toxic": np.append(held[1, some], rows[1])})


def log_count_ratios(sample: DataFrame, smooth: float = SMOOTH, least: float = LEAST_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """Ratios per feature (0 where unseen or below ``least``), and the rows of each class."""
    sums = materialize(sample.mapInPandas(_count, "id long, clean long, toxic long")
                       .groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "class-counts")
    total = sums.where("id < 0").toPandas()
    rows, ratio = np.array([total["clean"].sum(), total["toxic"].sum()], dtype=float), np.zeros(1 << BITS)
    if rows.min() > 0:
        share = rows / rows.sum()
        log = F.log((F.col("toxic") + float(smooth * share[1])) / float(rows[1])
                    / ((F.col("clean") + float(smooth * share[0])) / float(rows[0])))
        got = sums.where("id >= 0").select("id", log.alias("r")).where(F.abs("r") >= least).toPandas()
        ratio[got["id"].to_numpy()] = got["r"].to_numpy()
    return ratio, rows


def _fit_logistic(y: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int,
                  l2: float = 5.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Adam on the whole sample; sparse features as (row, col, value)."""
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[col], len(y)) + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = (np.bincount(col, value * off[row], width) + l2 * w) / len(y)
        gb = off.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Weight per feature (ratio included) and intercept."""
    sample = labelled_sample(docs, labels, F.col("toxic"), max_rows)
    ratio, rows = log_count_ratios(sample)
    if rows.min() == 0:
        share = rows[1] / rows.sum() if rows.sum() else 0.0
        return np.zeros(1 << BITS), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    scale = sample.sparkSession.sparkContext.broadcast(ratio)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, hasher = scale.value, Hasher(ORDERS, BITS)
        for pdf in batches:
            yield pdf.assign(ids=[hasher.present(t, r != 0).astype(np.int32) for t in pdf["text"]])[["y", "k", "ids"]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "k"])  # rounding, and so the model, doesn't depend on arrival
        col = np.concatenate(list(pdf["ids"])).astype(np.int64)
        row = np.repeat(np.arange(len(pdf)), [len(i) for i in pdf["ids"]])
        used, dense = np.unique(col, return_inverse=True)
        w, b = _fit_logistic(pdf["y"].to_numpy(float), row, dense, scale.value[col], len(used))
        return pd.DataFrame({"id": np.append(used, -1), "weight": np.append(w * scale.value[used], b)})

    # Texts are hashed in parallel; the one task that fits gets at most 2**BITS ids of a row.
    hashed = sample.withColumn("k", F.xxhash64("text")).mapInPandas(features, "y int, k long, ids array<int>")
    got = hashed.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "id long, weight double").toPandas()
    scale.unpersist()
    weights = np.zeros(1 << BITS)
    some = got[got["id"] >= 0]
    weights[some["id"].to_numpy()] = some["weight"].to_numpy()
    return weights, float(got.loc[got["id"] < 0, "weight"].iloc[0])


def score_column(spark, model: tuple[np.ndarray, float]):
    """A pandas UDF from whole text to the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (weights, b), hasher = shared.value, Hasher(ORDERS, BITS)
        used = weights != 0
        for texts in batches:
            z = np.array([weights[hasher.present(t, used)].sum() + b for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = score_column(docs.sparkSession, train(docs, labels, max_rows))
    return (docs.select("doc_id", held_out().alias("held_out"), score(text_of()).alias("score"))
                .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (all columns) without those that the classifier rejects."""
    score = score_column(docs.sparkSession, train(docs, labels, max_rows))
    return docs.where(score(text_of()) < 0.5)
