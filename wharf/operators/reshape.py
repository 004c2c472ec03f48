"""Unions, unpivot, relabel, dimension lookups and freshness labels
(O-02..O-05, J-02, J-03, J-07, X-11, X-12, A-05, A-06)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharf.functions.casts import nested_replace
from wharf.functions.periods import data_as_of_label, fyq_as_of_label


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """O-02/O-03 UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def unpivot_notnull(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                    name: str = "Attribute", value: str = "Value",
                    relabel: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """O-04 SQL UNPIVOT (NULL values excluded) + O-05 nested REPLACE relabel.

    DataFrame.unpivot keeps NULL cells, BigQuery/Spark SQL UNPIVOT drops them.
    """
    out = df.unpivot(list(ids), list(cols), name, value).where(F.col(value).isNotNull())
    if relabel:
        out = out.withColumn(name, nested_replace(F.col(name), relabel))
    return out


def dim_lookup(df: DataFrame, dim: DataFrame, left_key: Column, right_key: str,
               cols: Sequence[str]) -> DataFrame:
    """J-02/J-03 LEFT JOIN to a DISTINCT projection of a dimension on a
    (possibly computed) key. Fan-out when one description has two keys is the
    reference's behaviour and is kept. The join strategy is chosen by AQE from
    the dimension's measured size.
    """
    right = dim.select(F.col(right_key).alias("__dim_key"), *cols).distinct()
    return (df.join(right, left_key == F.col("__dim_key"), "left").drop("__dim_key"))


def data_as_of(probes: Mapping[str, tuple[DataFrame, Column, str]]) -> DataFrame:
    """M-02/X-11 freshness table [View_name, datekey, Data_as_of] (O-02, A-05).

    A probe is (table, key, kind); ``kind``: 'datekey' the maximum as text, 'date' a
    date without its dashes, 'fyq' a quarter label. Datekey-like probes get 'End Of Mon yyyy',
    FYQ probes 'Qq Of 20yy'. The probes of one DataFrame share one global
    aggregate, so a table is read once however many views look at it.
    """
    by_table: dict[int, tuple[DataFrame, list]] = {}
    for name, (df, key, kind) in probes.items():
        by_table.setdefault(id(df), (df, []))[1].append((name, key, kind))
    parts = []
    for df, asked in by_table.values():
        tops = df.agg(*[F.max(key).alias(f"m{i}") for i, (_, key, _) in enumerate(asked)])
        rows = []
        for i, (name, _, kind) in enumerate(asked):
            text = F.col(f"m{i}").cast("string")
            if kind == "date":
                text = F.replace(text, F.lit("-"), F.lit(""))
            rows.append(F.struct(F.lit(name).alias("View_name"), text.alias("datekey"), F.lit(kind == "fyq").alias("fyq")))
        parts.append(tops.select(F.inline(F.array(*rows))))
    label = F.when(F.col("fyq"), fyq_as_of_label(F.col("datekey"))).otherwise(data_as_of_label(F.col("datekey")))
    return union_all(parts).groupBy("View_name", "datekey").agg(F.max(label).alias("Data_as_of"))


def kpi_freshness(kpis: DataFrame, timings: DataFrame, as_of: DataFrame) -> DataFrame:
    """M-03/J-07 KPI list LEFT JOIN refresh timings LEFT JOIN data-as-of."""
    t = timings.select(F.col("DataFeedName").alias("__feed"), "DataLoadCompletionDTM",
                       "PBICompletionDTM")
    a = as_of.select(F.col("View_name").alias("__view"), "Data_as_of")
    return (kpis.join(t, kpis["data_refresh_feed_source_name"] == t["__feed"], "left")
                .join(a, kpis["view"] == a["__view"], "left")
                .select("data_source", "data_refresh_feed_source_name", "data_refresh_cycle",
                        "kpi", "view", "Data_as_of", "DataLoadCompletionDTM", "PBICompletionDTM"))
