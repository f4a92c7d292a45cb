"""Log-bucketed quantile summary, exact quantiles, running totals and CDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DD, SummaryConfig

GAMMA = 1.001


def bucket(value: Column, cfg: SummaryConfig = DD) -> Column:
    """The value's bucket; 0 (whose logarithm is undefined) goes to the first, large values to the last."""
    v = value.cast("double")
    return F.when(v >= 1, F.least(F.lit(cfg.length - 1), F.floor(F.ln(v) / F.lit(math.log(GAMMA))))).otherwise(0).cast("int")


def dd_build(df: DataFrame, cfg: SummaryConfig = DD, by: tuple = ()) -> DataFrame:
    """(bucket, value) cells of the items ``key``."""
    return df.select(*by, bucket(F.col("key"), cfg).alias("bucket")).groupBy(*by, "bucket").agg(F.count("*").alias("value"))


def running(counts: DataFrame, by: str, n: str, width: int) -> DataFrame:
    """``counts`` with ``before`` (the sum of ``n`` at smaller ``by``) and
    ``total``.  Sums of ``width`` wide ranges are added up first, so the full
    table is never ordered in one task; the ranges are few."""
    ranged = counts.withColumn("_range", F.floor(F.col(by) / width))
    ranges = ranged.groupBy("_range").agg(F.sum(n).alias("_n"))
    ranges = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inner = F.sum(n).over(Window.partitionBy("_range").orderBy(by)) - F.col(n)
    return ranged.withColumn("_inner", inner).join(ranges, "_range").withColumn("before", F.col("_base") + F.col("_inner")).drop("_range", "_base", "_inner")


def _permilles(run: DataFrame, n: str) -> DataFrame:
    """A row for each i of 0..999 at the first entry whose running sum exceeds i * total / 1000."""
    low, high = F.ceil(F.col("before") * 1000 / F.col("total")), F.ceil((F.col("before") + F.col(n)) * 1000 / F.col("total")) - 1
    return run.withColumns({"_a": low.cast("int"), "_b": F.least(high, F.lit(999)).cast("int")}).where("_a <= _b").withColumn("permille", F.explode(F.sequence("_a", "_b")))


def dd_query(cells: DataFrame, cfg: SummaryConfig = DD) -> DataFrame:
    """(permille, value) for 0..999; no rows for an empty summary.  There are
    ``length`` cells at most."""
    value = F.floor(F.lit(2.0) * F.pow(F.lit(GAMMA), (F.col("bucket") + 1).cast("double")) / F.lit(1 + GAMMA)).cast("int")
    return _permilles(running(cells, "bucket", "value", 256), "value").select("permille", value.alias("value"))


def exact_permille(df: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(permille, value): the items' order statistics floor(i * n / 1000)."""
    return _permilles(running(df.groupBy("key").agg(F.count("*").alias("n")), "key", "n", width), "n").select("permille", F.col("key").alias("value"))


def rank_report(df: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Permilles 1 to 999 of the items."""
    return exact_permille(df, width).where("permille >= 1")


def cdf(counts: DataFrame, by: str = "key", n: str = "n", width: int = 1 << 16) -> DataFrame:
    """(by, share): the share of all at or below each value."""
    return running(counts, by, n, width).select(by, ((F.col("before") + F.col(n)) / F.col("total")).alias("share"))
