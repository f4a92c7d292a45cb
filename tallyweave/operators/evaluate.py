"""Accuracy of estimates against the truth, above a heavy-hitter threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(n: int, alpha: float) -> int:
    return int(n * alpha)


def accuracy(truth: DataFrame, estimates: DataFrame, above: int) -> DataFrame:
    """One row: recall (cr) and precision (pr) of keys strictly above the
    threshold, and the mean absolute and relative error over keys that are so
    in both.  Without such keys the figures are null.  ``truth``: key, cnt."""
    both = F.col("real") & F.col("said")
    joined = truth.select("key", "cnt").join(estimates.select("key", "est"), "key", "full")
    joined = joined.withColumns({"real": F.coalesce(F.col("cnt") > above, F.lit(False)), "said": F.coalesce(F.col("est") > above, F.lit(False))})
    error = F.when(both, F.abs(F.col("cnt") - F.col("est")))
    out = joined.agg(F.count_if("real").alias("n_real"), F.count_if("said").alias("n_est"), F.count_if(both).alias("n_both"), F.sum(error).alias("absolute"), F.sum(error / F.col("cnt")).alias("relative"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return out.select("n_real", "n_est", "n_both", ratio("n_both", "n_real").alias("cr"), ratio("n_both", "n_est").alias("pr"), ratio("absolute", "n_both").alias("aae"), ratio("relative", "n_both").alias("are"))


def report(metrics: DataFrame) -> str:
    """The one-row metrics as a line for a console."""
    r = metrics.first()
    return f"CR: {r['cr']} PR: {r['pr']} AAE: {r['aae']} ARE: {r['are']}"
