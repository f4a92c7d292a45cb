"""Summaries as DataFrames of cells: what all of them share.

A cell absent from a table is zero.  Building never shuffles keys: each task
aggregates its own rows into cells first, so at most the summary's own size
leaves a task, however many rows or however heavy a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, structs: list[Column], *keep: str) -> DataFrame:
    """A row for each struct of each row, beside the columns to keep."""
    return df.select(*keep, F.explode(F.array(*structs)).alias("_c")).select(*keep, "_c.*")


def merged_sum(*cells: DataFrame, value: str = "value") -> DataFrame:
    """The cells of the union of what the summaries saw (additive counters)."""
    keys = [c for c in cells[0].columns if c != value]
    return reduce(DataFrame.unionByName, cells).groupBy(*keys).agg(F.sum(value).alias(value))


def merged_max(*cells: DataFrame, value: str = "rank") -> DataFrame:
    """The same for registers."""
    keys = [c for c in cells[0].columns if c != value]
    return reduce(DataFrame.unionByName, cells).groupBy(*keys).agg(F.max(value).alias(value))


def apply_deltas(cells: DataFrame, deltas: DataFrame, value: str = "value") -> DataFrame:
    keys = [c for c in cells.columns if c != value]
    return merged_sum(cells, deltas.select(*keys, value), value=value)


def looked_up(keys: DataFrame, cells: DataFrame, structs: list[Column], keep: tuple, value: str = "value") -> DataFrame:
    """(keep..., the structs' fields, the cell's value): each key beside its
    cells.  ``structs`` give (row, pos, ...) and ``keep`` the key, with its level
    if cells have one.  The cells are built and broadcast once; a summary row has
    ``length`` of them, at most 65536 by default (times the levels), whatever
    the data.  Keys stay where they are, so a later aggregation by key does not
    shuffle them again."""
    on = [c for c in ("level", "row", "pos") if c in cells.columns]
    return exploded(keys, structs, *keep).join(F.broadcast(cells.select(*on, value)), on, "left")
