"""Exact answers, the truth that summaries are measured against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.count("*").alias("cnt"))


def cardinality(df: DataFrame) -> DataFrame:
    """key 0 -> the number of distinct keys."""
    return df.agg(F.count_distinct("key").alias("cnt")).select(F.lit(0).cast("long").alias("key"), "cnt")


def spread(df: DataFrame) -> DataFrame:
    """Distinct destinations of each source; distinct pairs first, so that a
    busy source spreads over many tasks."""
    return df.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("cnt"))
