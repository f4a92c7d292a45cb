"""Super-spreaders: sources by their number of distinct destinations.

A cell is a small estimator of sixteen registers; a source's estimate is the
median over rows of its cell's estimate less the row's mean noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SPREAD, SummaryConfig
from ..functions.hashing import with_hashes, words
from ..functions.scalars import int32, median3, rank
from .cells import exploded, looked_up
from .topk import top_k

CAP, REGISTERS_IN_CELL, SCALE = 15, 16, 0.673 * 256


def spread_items(df: DataFrame, cfg: SummaryConfig = SPREAD, keep: tuple = ()) -> DataFrame:
    """(row, pos, reg, rank) of each (src, dst) item."""
    h = with_hashes(df.select("src", "dst", *keep), {f"{k}{r}": (words(c, 4), r) for k, c in (("s", "src"), ("d", "dst")) for r in range(cfg.rows)})
    structs = [F.struct(F.lit(r).alias("row"), (F.col(f"s{r}") % cfg.length).cast("int").alias("pos"), F.col(f"d{r}").bitwiseAND(F.lit(15)).cast("int").alias("reg"), rank(f"d{r}", CAP).alias("rank")) for r in range(cfg.rows)]
    return exploded(h, structs, *keep)


def spread_build(df: DataFrame, cfg: SummaryConfig = SPREAD, by: tuple = ()) -> DataFrame:
    return spread_items(df, cfg, by).groupBy(*by, "row", "pos", "reg").agg(F.max("rank").alias("rank"))


def cell_estimates(cells: DataFrame, base: int = 0) -> DataFrame:
    """(row, pos, e): ``base`` is the rank that registers start from."""
    powers = F.sum(F.pow(F.lit(2.0), -F.greatest(F.lit(base), F.col("rank")).cast("double")))
    return cells.groupBy("row", "pos").agg((F.lit(SCALE) / ((F.lit(REGISTERS_IN_CELL) - F.count("*")) * F.lit(2.0**-base) + powers)).alias("e"))


def spread_query(cells: DataFrame, sources: DataFrame, cfg: SummaryConfig = SPREAD, base: int = 0) -> DataFrame:
    """(key, est) of the candidate sources ``key``."""
    empty = SCALE / (REGISTERS_IN_CELL * 2.0**-base)
    row = Window.partitionBy("row")  # of at most ``length`` cells
    total = F.sum("e").over(row) + (F.lit(cfg.length) - F.count("*").over(row)) * F.lit(empty)
    e = cell_estimates(cells, base).withColumn("total", total).select("row", "pos", (F.col("e") - (F.col("total") - F.col("e")) / F.lit(cfg.length - 1.0)).alias("e"))
    h = with_hashes(sources.select("key"), {f"s{r}": (words("key", 4), r) for r in range(cfg.rows)})
    structs = [F.struct(F.lit(r).alias("row"), (F.col(f"s{r}") % cfg.length).cast("int").alias("pos")) for r in range(cfg.rows)]
    found = looked_up(h, e, structs, ("key",), "e").groupBy("key").agg(*[F.max(F.when(F.col("row") == r, F.coalesce("e", F.lit(0.0)))).alias(f"e{r}") for r in range(3)])
    # Rounded first: the noise is a sum of doubles whose order varies.
    return found.select("key", int32(F.round(median3(*[F.col(f"e{r}") for r in range(3)]), 6)).alias("est"))


def spread_topk(df: DataFrame, cfg: SummaryConfig = SPREAD) -> DataFrame:
    return top_k(spread_query(spread_build(df, cfg), df.select(F.col("src").alias("key")).distinct(), cfg), cfg.k)
