"""Scalar expressions of the summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank(h: str | Column, cap: int) -> Column:
    """Leading zeros of a 32-bit hash plus one, at most ``cap``; 33 zeros (hash 0) give the cap."""
    h = F.col(h) if isinstance(h, str) else h
    return F.least(F.lit(cap), F.lit(33) - F.length(F.bin(h))).cast("int")


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def int32(x: Column) -> Column:
    """Truncate toward zero, as result maps hold 32-bit values."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def pair_key(src: str | Column, dst: str | Column) -> Column:
    """A (source, destination) pair as one key: the source in the low word."""
    s, d = (F.col(x) if isinstance(x, str) else x for x in (src, dst))
    return F.shiftleft(d.cast("long"), 32).bitwiseOR(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
