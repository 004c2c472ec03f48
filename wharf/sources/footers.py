"""Maxima and counts from Parquet footers (A-01, O-02, X-11).

A freshness probe asks one stored column for its maximum. Spark's DataSource V2
Parquet reader answers that from the footers (``PushedAggregation`` in the
plan): a task opens the end of a file and reads no row. The two settings that
choose this reader hold in a session of their own, so other reads of the
caller's session keep theirs.

A column is pushed down where its footer statistics are exact: whole numbers,
floating point, booleans and dates. For texts, decimals and timestamps Spark
plans an ordinary scan of that column with the same result; a text such as a
quarter label is better kept as a partition column (``partition_values``).

A file that holds only NULLs of a column has no maximum in its footer, and
Spark fails there. ``for_maxima`` asks the footers for the NULL counts first
and gives the ordinary reader for columns that hold any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose footer minimum and maximum Spark takes for an aggregate.
PUSHED_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                T.FloatType, T.DoubleType, T.DateType)


def footer_reader(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``, read so that plain MIN, MAX and COUNT come from footers.

    Meant for unfiltered aggregates (grouped by partition columns at most); on
    anything else it is a plain scan.
    """
    other = spark.newSession()
    other.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return other.read.parquet(path)


def for_maxima(spark: SparkSession, path: str, columns: Sequence[str]) -> dict[str, DataFrame]:
    """For each column the reader of the table at ``path`` to ask for its maximum:
    ``footer_reader`` where the column has a pushed type and no NULLs, else the caller's own."""
    stored, plain = footer_reader(spark, path), spark.read.parquet(path)
    able = [c for c in columns if is_pushed(stored, c)]
    if not able:
        return {c: plain for c in columns}
    counts = stored.agg(F.count(F.lit(1)), *[F.count(c) for c in able]).first()
    full = {c for c, n in zip(able, counts[1:]) if n == counts[0]}
    return {c: stored if c in full else plain for c in columns}


def is_pushed(df: DataFrame, column: str) -> bool:
    """Whether the maximum of ``column`` can come from footers."""
    return isinstance(df.schema[column].dataType, PUSHED_TYPES)


def partition_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a partition column that have rows, one row each: [column, rows].

    Row counts come from the footers, so partitions of empty files are left out.
    """
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where("rows > 0")
