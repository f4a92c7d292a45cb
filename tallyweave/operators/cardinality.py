"""HyperLogLog and LogLog registers, without range corrections unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import REGISTERS, SummaryConfig
from ..functions.hashing import RANK_SEED, hash_key
from ..functions.scalars import int32, rank

CAP = 31


def register_items(df: DataFrame, cfg: SummaryConfig = REGISTERS, keep: tuple = ()) -> DataFrame:
    h = hash_key(df.select("key", *keep), "key", {"h": 0, "r": RANK_SEED})
    return h.select(*keep, (F.col("h") % cfg.length).cast("int").alias("pos"), rank("r", CAP).alias("rank"))


def register_build(df: DataFrame, cfg: SummaryConfig = REGISTERS, by: tuple = ()) -> DataFrame:
    return register_items(df, cfg, by).groupBy(*by, "pos").agg(F.max("rank").alias("rank"))


def _sums(registers: DataFrame, cfg: SummaryConfig) -> DataFrame:
    """Absent registers are zero: each counts 1 among the powers."""
    return registers.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("rank"), F.lit(0)).alias("ranks"), (F.lit(cfg.length) - F.count("*") + F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0))).alias("powers")
    )


def hll_estimate(registers: DataFrame, cfg: SummaryConfig = REGISTERS, corrected: bool = False) -> DataFrame:
    """key 0 -> the estimate.  ``corrected``: linear counting where the raw
    estimate is small and registers are empty."""
    m = cfg.length
    raw = F.lit(0.7213 * m / (m + 1.079) * m) / F.col("powers")
    if corrected:
        linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / (F.lit(m) - F.col("n")))
        raw = F.when((raw <= 2.5 * m) & (F.col("n") < m), linear).otherwise(raw)
    return _sums(registers, cfg).select(F.lit(0).cast("long").alias("key"), int32(raw).alias("est"))


def ll_estimate(registers: DataFrame, cfg: SummaryConfig = REGISTERS) -> DataFrame:
    m = cfg.length
    return _sums(registers, cfg).select(F.lit(0).cast("long").alias("key"), int32(F.lit(0.39701 * m) * F.pow(F.lit(2.0), F.col("ranks") / m)).alias("est"))
