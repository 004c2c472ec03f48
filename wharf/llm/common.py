"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wharf.session import shuffles_freed  # noqa: F401

#: White space of the word definitions: space and U+0009..U+000D.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, faster, where all is ASCII."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
             .otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase)))


def delete(spark: SparkSession, path: str) -> None:
    """Scratch that nothing reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[0]..starts[0]+lengths[0]-1, then of starts[1].. in one array."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)
