"""Top-k candidates: the k largest estimates, ties by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(estimates: DataFrame, k: int) -> DataFrame:
    return estimates.orderBy(F.desc("est"), "key").limit(k)


def least_of_top(estimates: DataFrame, k: int) -> DataFrame:
    return top_k(estimates, k).agg(F.min("est").alias("least"))


def key_slots(memory_bytes: int, entry_bytes: int = 16) -> int:
    """How many candidates fit in so many bytes; ``slot_bytes`` is its inverse."""
    return memory_bytes // entry_bytes


def slot_bytes(k: int, entry_bytes: int = 16) -> int:
    return k * entry_bytes
