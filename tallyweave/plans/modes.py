"""How a summary is built from a stream: in one pass, by periodic merging, or
by change-based shipping.

Workers are a column (the hash of the key modulo their number).  In periodic
mode each worker hands its summary over every interval * workers items,
staggered by worker, and starts anew; in change mode a cell ships what it
counted whenever that reaches the threshold.  What is left at the end is lost
unless ``flush_residual`` is set.

Additive summaries need no walk in change mode: with n items of a worker in a
cell it ships floor(n / T) times T.  Registers ship every improvement, so the
parent's equal those of a single pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CM, COUNT, DD, SPREAD, LEVELS, SummaryConfig
from ..functions.hashing import WORKER_SEED, with_hashes, with_worker, words
from ..operators.cells import merged_sum
from ..operators.folds import signed_deltas
from ..operators.frequency import cm_items, count_items, levels_items
from ..operators.quantiles import bucket
from ..operators.spread import spread_build


def pair_worker(df: DataFrame, workers: int) -> DataFrame:
    """The worker of each (src, dst) pair: both words are hashed."""
    return with_hashes(df, {"_w": ([*words("src", 4), *words("dst", 4)], WORKER_SEED)}).withColumn("worker", (F.col("_w") % workers).cast("int")).drop("_w")


def epochs(df: DataFrame, order: list[str], cfg: SummaryConfig, first: int = 1) -> DataFrame:
    """``df`` (with worker) with the epoch in which each item is handed over;
    items after a worker's last hand-over are dropped unless flushed.
    ``first``: the number of a worker's first item (0 on live bindings)."""
    by, period = Window.partitionBy("worker"), cfg.interval * cfg.workers
    n, total = F.row_number().over(by.orderBy(*order)) - 1 + first, F.count("*").over(by) - 1 + first
    df = df.withColumns({"_n": n, "_total": total, "_shift": F.col("worker") * cfg.interval})
    last = F.when(F.col("_total") >= F.col("_shift"), F.col("_shift") + F.floor((F.col("_total") - F.col("_shift")) / period) * period).otherwise(-1)
    kept = df if cfg.flush_residual else df.where(F.col("_n") <= last)
    return kept.withColumn("epoch", F.greatest(F.lit(0), F.ceil((F.col("_n") - F.col("_shift")) / period)).cast("int")).drop("_n", "_total", "_shift")


def periodic(df: DataFrame, order: list[str], cfg: SummaryConfig, build: Callable, merge: Callable = merged_sum, first: int = 1) -> DataFrame:
    """Summaries of each (worker, epoch), merged."""
    handed = epochs(df if "worker" in df.columns else with_worker(df, cfg.workers), order, cfg, first)
    return merge(build(handed, cfg, ("worker", "epoch")).drop("worker", "epoch"))


def _shipped(cfg: SummaryConfig, n: str = "value", strict: bool = False):
    """What additive cells have shipped.  ``strict``: they ship above the threshold."""
    t = cfg.threshold + strict
    return F.col(n) if cfg.flush_residual else (F.floor(F.col(n) / t) * t)


def additive_change(items: DataFrame, cells: list[str], cfg: SummaryConfig, strict: bool = False) -> DataFrame:
    """Parent cells of ``items`` (worker and cell columns) in change mode."""
    own = items.groupBy("worker", *cells).agg(F.count("*").alias("value"))
    return own.select(*cells, _shipped(cfg, strict=strict).cast("long").alias("value")).where("value > 0").groupBy(*cells).agg(F.sum("value").alias("value"))


def cm_change(df: DataFrame, cfg: SummaryConfig = CM, strict: bool = False) -> DataFrame:
    return additive_change(cm_items(with_worker(df, cfg.workers), cfg, ("worker",)), ["row", "pos"], cfg, strict)


def dd_change(df: DataFrame, cfg: SummaryConfig = DD, strict: bool = False) -> DataFrame:
    return additive_change(with_worker(df, cfg.workers).select("worker", bucket(F.col("key"), cfg).alias("bucket")), ["bucket"], cfg, strict)


def count_change(df: DataFrame, order: list[str], cfg: SummaryConfig = COUNT, strict: bool = False) -> DataFrame:
    """Signed cells depend on the walk: a sorted fold for each worker's cell."""
    items = count_items(with_worker(df, cfg.workers), cfg, ("worker", *order))
    return signed_deltas(items, ["worker", "row", "pos"], order, cfg.threshold, cfg.flush_residual, strict).groupBy("row", "pos").agg(F.sum("value").alias("value"))


def levels_change(df: DataFrame, order: list[str], cfg: SummaryConfig = LEVELS) -> DataFrame:
    items = levels_items(with_worker(df, cfg.workers), cfg, ("worker", *order))
    return signed_deltas(items, ["worker", "level", "row", "pos"], order, cfg.threshold, cfg.flush_residual).groupBy("level", "row", "pos").agg(F.sum("value").alias("value"))


def spread_change(df: DataFrame, cfg: SummaryConfig = SPREAD) -> DataFrame:
    """Registers start at 1 on both sides, so rank 1 never ships; query with base 1."""
    return spread_build(df, cfg).where(F.col("rank") > cfg.threshold)


def partition_skew(df: DataFrame, workers: int) -> DataFrame:
    """(worker, n): how evenly keys spread over workers."""
    return with_worker(df, workers).groupBy("worker").agg(F.count("*").alias("n"))
