"""Embedding whitening through the exact characteristic polynomial of the scatter.

Entries become integers, so all moments are exact: tasks add up integer partial
sums, Spark adds those. n * sum(x x') - S S' is then n times the scatter of the
centred vectors without any rounding, and n^2 times the covariance. Its
characteristic polynomial is computed modulo 31-bit primes (one Spark row per
prime, Hessenberg reduction) and put together by Chinese remainders; the largest
roots are isolated exactly; inverse iteration in long decimals gives the components
(one Spark row per root). Only matrices of the vector dimension reach the driver,
never rows.

Defined results: a null vector, or one with a null or non-finite entry, is dropped;
so is an entry of 2^30 or more (its squared deviation fits in no long). Vectors of
another length than the most frequent one (ties: the longer) are left out.
``deviation`` is null where it does not fit in a long. Components with eigenvalue
zero do not exist: equal vectors or an empty table give no rows. Null and repeated
keys give their rows like any other. Columns other than key and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations_with_replacement
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.llm.charpoly import charpoly_mod, combine, largest_roots, null_vectors, primes_for
from wharf.session import materialize

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
_LARGEST = float(1 << 30)
_CHUNK = 8192

SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def lattice(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and y = floor(1024 * c) of the rows kept; x is y + 100000."""
    fits = F.forall("v", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < _LARGEST))
    valid = table.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).where(fits & (F.size("v") > 0))
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = sizes["d"] if sizes else 0
    return valid.where(F.size("v") == dims).select(
        "vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("y"))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), dtype=object)
        for batch in batches:
            y = _rows(batch, dims)
            for at in range(0, len(y), _CHUNK):
                z = np.hstack([np.ones((len(y[at:at + _CHUNK]), 1), np.int64), y[at:at + _CHUNK]])
                # Products below 2^40, 2^13 of them: sums of doubles are exact.
                small = np.abs(z).max() < 1 << 20
                z = z.astype(np.float64 if small else object)
                sums = z.T @ z
                total = total + (sums.astype(np.int64) if small else sums).astype(object)
        at = np.triu_indices(dims + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
             pa.array([int(v) for v in total[at]], pa.decimal128(38, 0))], names=["i", "j", "v"])
    return run


def _dims(points: DataFrame) -> int:
    first = points.select(F.size("y").alias("d")).first()
    return first["d"] if first else 0


def exact_moments(points: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums, and n * sum(y y') - S S' as Python integers."""
    parts = points.select("y").mapInArrow(_moments(dims), "i int, j int, v decimal(38,0)")
    sums = {(r.i, r.j): int(r.v) for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n, s = sums[0, 0], [sums[0, j + 1] for j in range(dims)]
    return n, s, [[n * sums[min(i, j) + 1, max(i, j) + 1] - s[i] * s[j] for j in range(dims)] for i in range(dims)]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - matrix), lowest degree first, of a non-negative definite matrix."""
    primes = primes_for(len(matrix), sum(matrix[i][i] for i in range(len(matrix))))

    def run(batches):
        m = np.array(matrix, dtype=object)
        for pdf in batches:
            yield pdf.assign(c=[charpoly_mod(m, primes[i]).tolist() for i in pdf["id"]])

    rows = (spark.range(len(primes), numPartitions=min(len(primes), spark.sparkContext.defaultParallelism))
            .mapInPandas(run, "id long, c array<long>").collect())
    return combine({primes[r.id]: r.c for r in rows})


def principal_axes(spark: SparkSession, matrix: list[list[int]], wanted: int) -> list[tuple[Fraction, list[float]]]:
    """The largest eigenvalues of ``matrix`` (falling, never zero) with unit eigenvectors."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if trace == 0:
        return []
    coeffs = characteristic_polynomial(spark, matrix)
    while coeffs[0] == 0:                                     # roots zero: exactly the missing rank
        coeffs = coeffs[1:]
    roots = largest_roots(coeffs, wanted, trace)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(v=[null_vectors(matrix, *roots[i]) for i in pdf["id"]])

    rows = (spark.range(len(roots), numPartitions=len(roots))
            .mapInPandas(run, "id long, v array<array<double>>").collect())
    axes = {r.id: r.v for r in rows}
    return [(Fraction(lo + hi, 2 << s), v) for i, (lo, hi, s, _) in enumerate(roots) for v in axes[i]][:wanted]


def _project(dims: int, n: int, sums: list[int], axes: list[tuple[Fraction, list[float]]]):
    # y - S/n projected over sqrt(e) is (n y - S) projected over the root of n^2 e.
    lines = [np.array(v) / _root(value) for value, v in axes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _rows(batch, dims)
            wide = not len(y) or log2(n) + log2(int(np.abs(y).max()) + 1) > 61
            s = np.array(sums, dtype=object if wide else np.int64)
            off = (y.astype(object) if wide else y) * n - s
            real = off.astype(np.float64)
            if not wide and (real * real).sum(axis=1).max() < 2.0 ** 62:
                deviation = pa.array((off * off).sum(axis=1), pa.int64())
            else:
                exact = [sum(int(c) ** 2 for c in row) for row in off]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            w = np.stack([(real * line).sum(axis=1) for line in lines], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), deviation, pa.array(list(w), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "w"])
    return run


def _root(value: Fraction) -> float:
    """Square root of a rational of any size, in double precision."""
    shift = max(0, value.numerator.bit_length() - value.denominator.bit_length() - 900) // 2 * 2
    return sqrt(value / (1 << shift)) * 2.0 ** (shift // 2)


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity, centred first.

    Sums are decimals, so a rerun gives the same value.
    """
    exact = "decimal(38,18)"
    means = [float(v) / n for v in whitened.agg(*[F.sum(F.col("w")[i].cast(exact)) for i in range(k)]).first()]
    pairs = list(combinations_with_replacement(range(k), 2))
    sums = whitened.agg(*[F.sum(((F.col("w")[i] - means[i]) * (F.col("w")[j] - means[j])).cast(exact))
                          for i, j in pairs]).first()
    return max(abs(float(v) / n - (i == j)) for v, (i, j) in zip(sums, pairs))


def whiten(table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector kept and component: whitened value, explained share, exact deviation."""
    spark = table.sparkSession
    points = materialize(lattice(table, key, vector), "lattice")
    key_type = points.schema["vec_id"].dataType.simpleString()
    schema = SCHEMA.replace("vec_id long", f"vec_id {key_type}")
    dims = _dims(points)
    if not dims:
        return spark.createDataFrame([], schema)
    n, sums, matrix = exact_moments(points, dims)
    axes = principal_axes(spark, matrix, components)
    if not axes:
        return spark.createDataFrame([], schema)
    rows = materialize(points.mapInArrow(_project(dims, n, sums, axes),
                                         f"vec_id {key_type}, deviation long, w array<double>"), "whitened")
    trace = sum(matrix[i][i] for i in range(dims))
    share = F.array(*[F.lit(float(value / trace)) for value, _ in axes])
    error = identity_error(rows, n, len(axes))
    return rows.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
