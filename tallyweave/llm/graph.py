"""Connected components of undirected links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: A node of more edges is busy, and of so many edges in all there are at most as many busy nodes.
BUSY, BUSY_NODES = 100, 1000


def _beside_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m``, the least b of each a.  A busy node's edges stay
    where they are: such nodes are at most BUSY_NODES, and are broadcast.
    ``n``: how many edges there are at most."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    most = max(BUSY, n // BUSY_NODES)
    busy = [tuple(r) for r in least.where(F.col("n") > most).select("a", "m").collect()]
    if not busy:
        return edges.join(least.drop("n"), "a")
    sent = F.broadcast(edges.sparkSession.createDataFrame(busy, "a long, m long"))
    return edges.join(sent.select("a"), "a", "left_anti").join(least.drop("n"), "a").unionByName(edges.join(sent, "a"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _beside_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _beside_least(down, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(down.groupBy("a").agg(F.min("b").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: bigint); component
    is the smallest node reachable.  Loops are ignored.  A round keeps at most
    as many edges as it was given, a busy node's edges are never brought together
    but as a minimum, and each round's edges are written to the shared folder."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was, at = None, mark(now)
    while was != at:
        new = written(_small_star(_large_star(now, at[0]).where("a <> b"), at[0]).distinct(), "edges")
        dropped(now)
        now, was, at = new, at, mark(new)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the pairs (a, b),
    and over those that ``labels`` already joins."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels != labels[labels]).any():
            labels = labels[labels]
    return labels
