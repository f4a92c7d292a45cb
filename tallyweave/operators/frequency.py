"""Count-Min and Count summaries, and the universal summary of Count levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CM, COUNT, LEVELS, SummaryConfig
from ..functions.hashing import LEVEL_SEED, hash_key, seed_at, with_hashes, words
from ..functions.scalars import median3, rank
from .cells import exploded, looked_up
from .topk import top_k


def _cm_structs(cfg: SummaryConfig) -> list:
    return [F.struct(F.lit(r).alias("row"), (F.col(f"h{r}") % cfg.length).cast("int").alias("pos")) for r in range(cfg.rows)]


def cm_items(df: DataFrame, cfg: SummaryConfig = CM, keep: tuple = ()) -> DataFrame:
    """(row, pos) of each item, one row a summary row."""
    return exploded(hash_key(df.select("key", *keep), "key", {f"h{r}": r for r in range(cfg.rows)}), _cm_structs(cfg), *keep)


def _weighed(df: DataFrame, weight: str | None) -> DataFrame:
    return df.withColumn("_w", F.col(weight) if weight else F.lit(1))


def cm_build(df: DataFrame, cfg: SummaryConfig = CM, by: tuple = (), weight: str | None = None) -> DataFrame:
    """Count-Min cells (row, pos, value) of the items ``key``, each counted
    once, or ``weight`` times: keys that were counted before need one hash."""
    return cm_items(_weighed(df, weight), cfg, (*by, "_w")).groupBy(*by, "row", "pos").agg(F.sum("_w").alias("value"))


def cm_query(cells: DataFrame, keys: DataFrame, cfg: SummaryConfig = CM) -> DataFrame:
    """(key, est): the least of a key's cells.  ``keys``: distinct candidates."""
    h = hash_key(keys.select("key"), "key", {f"h{r}": r for r in range(cfg.rows)})
    return looked_up(h, cells, _cm_structs(cfg), ("key",)).groupBy("key").agg(F.min(F.coalesce("value", F.lit(0))).cast("int").alias("est"))


def _signed(df: DataFrame, cfg: SummaryConfig, keep: tuple) -> DataFrame:
    """Hashes h0, h1, ... of ``key``; under the seeds of its level if there is one."""
    if "level" in keep:
        seeds = {f"h{r}": (words("key", 8), seed_at(F.col("level") * cfg.rows + r, cfg.levels * cfg.rows)) for r in range(cfg.rows)}
        return with_hashes(df.select("key", *keep), seeds)
    return hash_key(df.select("key", *keep), "key", {f"h{r}": r for r in range(cfg.rows)})


def _count_structs(cfg: SummaryConfig) -> list:
    return [F.struct(F.lit(r).alias("row"), (F.shiftright(f"h{r}", 1) % cfg.length).cast("int").alias("pos"), (1 - 2 * (F.col(f"h{r}") % 2)).cast("int").alias("sign")) for r in range(cfg.rows)]


def count_items(df: DataFrame, cfg: SummaryConfig = COUNT, keep: tuple = ()) -> DataFrame:
    """(row, pos, sign) of each item; signs follow the hash's lowest bit."""
    return exploded(_signed(df, cfg, keep), _count_structs(cfg), *keep)


def count_build(df: DataFrame, cfg: SummaryConfig = COUNT, by: tuple = (), weight: str | None = None) -> DataFrame:
    """Count summary cells (row, pos, value)."""
    return count_items(_weighed(df, weight), cfg, (*by, "_w")).groupBy(*by, "row", "pos").agg(F.sum(F.col("sign") * F.col("_w")).alias("value"))


def count_query(cells: DataFrame, keys: DataFrame, cfg: SummaryConfig = COUNT, by: tuple = ()) -> DataFrame:
    """(key, est): the median of a key's signed cells.  ``by``: level, where cells and keys have one."""
    found = looked_up(_signed(keys, cfg, by), cells, _count_structs(cfg), ("key", *by))
    signed = F.coalesce(F.col("value") * F.col("sign"), F.lit(0))
    rows = found.groupBy("key", *by).agg(*[F.max(F.when(F.col("row") == r, signed)).alias(f"v{r}") for r in range(3)])
    return rows.select("key", *by, median3(*[F.col(f"v{r}") for r in range(3)]).cast("int").alias("est"))


def with_levels(df: DataFrame, cfg: SummaryConfig = LEVELS) -> DataFrame:
    """``df`` with a row for each level a key reaches, 0 up to its highest."""
    h = hash_key(df, "key", {"_l": LEVEL_SEED})
    return h.withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.lit(cfg.levels - 1), rank("_l", 33) - 1)))).drop("_l")


def levels_items(df: DataFrame, cfg: SummaryConfig = LEVELS, keep: tuple = ()) -> DataFrame:
    """(level, row, pos, sign) of each item, at each level up to its own."""
    return count_items(with_levels(df.select("key", *keep), cfg), cfg, (*keep, "level"))


def levels_build(df: DataFrame, cfg: SummaryConfig = LEVELS, by: tuple = (), weight: str | None = None) -> DataFrame:
    return levels_items(_weighed(df, weight), cfg, (*by, "_w")).groupBy(*by, "level", "row", "pos").agg(F.sum(F.col("sign") * F.col("_w")).alias("value"))


def levels_query(cells: DataFrame, keys: DataFrame, cfg: SummaryConfig = LEVELS) -> DataFrame:
    """(key, level, est): the union of the levels' top-k; of a key's levels the
    lowest.  Ranks are limited before they are shuffled."""
    found = count_query(cells, with_levels(keys.select("key"), cfg), cfg, ("level",))
    best = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("est"), "key"))
    found = found.withColumn("_r", best).where(F.col("_r") <= cfg.k)
    first = F.row_number().over(Window.partitionBy("key").orderBy("level"))
    return found.withColumn("_n", first).where("_n = 1").select("key", "level", "est")
