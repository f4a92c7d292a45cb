"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors are first made one with a weight.  Each tree splits the space
again and again by a random direction at its median; rows near a split go to
both sides (spill: a share of the rows, and at least a share of the distance of
a pair that just links), so that near pairs seldom part; several trees make up
for those that do.  A node most of whose pairs link, or nearly so, is split no
further: its pairs differ by noise alone, and every split would part some.
Vectors that share a leaf are compared by cosine in double precision, and links
are counted and united.

Each vector carries the leaves it falls in, so a pair that meets in several
leaves is counted in the first of them alone and no pairs travel: a task
returns a count for each vector and a spanning forest.  Leaves too full for
one task are split in parts, and each pair of parts meets once.

The trees are fitted on at most ``SAMPLE`` distinct vectors (those with the
smallest hash); every vector is put into the index.  The index is approximate:
its recall against brute force is measured in the tests.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do vectors of different lengths.  Null ids are allowed: a
component's id is its least id that is not null.  Repeated rows are separate
vectors that link.  An empty table gives an empty result; other columns
(labels too) are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import smallest, table, written
from .graph import connected_components, local_components

LEAST = 0.9
#: Vectors the trees are fitted on; rows aimed at in a leaf; least sampled rows in a leaf; trees; share of rows on each side of a split that spills.
SAMPLE, LEAF, SAMPLED_LEAF, TREES, SPILL = 50_000, 384, 32, 4, 0.08
#: Half of a spill's least width, in standard deviations of the projected distance of a pair that just links.
MARGIN = 0.5
#: A node is left whole where this share of the pairs of so many sampled rows has a cosine of ``least`` minus NEAR or more.
WHOLE, PROBES, NEAR = 0.2, 128, 0.05
#: Rows of a leaf that one task takes; links of a block that are handled one by one.
PART, PAIRS = 1024, 1 << 15
SEED = 20


class Tree:
    """Nodes in heap order: directions, the bounds between which rows spill, and whether the node is left whole."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator, least: float = LEAST):
        self.depth = depth
        self.directions = rng.standard_normal((2**depth - 1, x.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.low, self.high = np.zeros(2**depth - 1), np.zeros(2**depth - 1)
        self.whole = np.zeros(2**depth - 1, bool)
        margin = MARGIN * np.sqrt(max(0, 2 - 2 * least) / x.shape[1])
        held = {0: np.arange(len(x))}
        for node in range(2**depth - 1):
            if node not in held:  # below a node left whole
                continue
            rows = held.pop(node)
            if self._dense(x[rows[:PROBES]], least):
                self.whole[node] = True
                continue
            p = x[rows] @ self.directions[node]
            cut, low, high = np.quantile(p, (0.5, 0.5 - SPILL, 0.5 + SPILL)) if len(p) else (0, 0, 0)
            self.low[node], self.high[node] = min(low, cut - margin), max(high, cut + margin)
            held[2 * node + 1], held[2 * node + 2] = rows[p < cut], rows[p >= cut]

    @staticmethod
    def _dense(probe: np.ndarray, least: float) -> bool:
        n = len(probe)
        return n > 3 and (probe @ probe.T >= least - NEAR).sum() - n >= WHOLE * n * (n - 1)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each row of ``x``, once for each leaf it falls in; a leaf is its node's number."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        ended = []
        for _ in range(self.depth):
            whole = self.whole[nodes]
            ended.append((rows[whole], nodes[whole]))
            rows, nodes = rows[~whole], nodes[~whole]
            p = np.empty(len(rows))
            for i in range(0, len(rows), 1 << 14):
                p[i : i + (1 << 14)] = np.einsum("ij,ij->i", x[rows[i : i + (1 << 14)]], self.directions[nodes[i : i + (1 << 14)]])
            left, right = p <= self.high[nodes], p >= self.low[nodes]
            rows, nodes = np.concatenate((rows[left], rows[right])), np.concatenate((2 * nodes[left] + 1, 2 * nodes[right] + 2))
        ended.append((rows, nodes))
        return tuple(np.concatenate(y) for y in zip(*ended, strict=True))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def leaf_links(x: np.ndarray, weight: np.ndarray, part: np.ndarray, leaves: np.ndarray, leaf: int, across: bool, least: float):
    """Counts of links first met in this leaf, and labels that the links join.
    ``across``: only pairs of different parts are this task's."""
    n = len(x)
    counts, labels = np.zeros(n, np.int64), np.arange(n)
    earlier = np.where(leaves < leaf, leaves, -1)
    # Leaves met before this one that two rows or more share, as columns of a matrix.
    ids, held = np.unique(earlier[earlier >= 0], return_counts=True)
    ids = ids[held > 1]
    shared = None
    step = max(1, (1 << 20) // max(n, 1))
    for s in range(0, n, step):
        near = x[s : s + step] @ x[s:].T >= least
        near &= np.arange(s, n) > np.arange(s, min(n, s + step))[:, None]
        if across:
            near &= part[s : s + step, None] != part[s:]
        i, j = np.nonzero(near & (labels[s : s + step, None] != labels[s:]))
        labels = local_components(n, i + s, j + s, labels)
        some = np.count_nonzero(near)
        if some > PAIRS:
            if len(ids):
                if shared is None:
                    shared = np.zeros((n, len(ids)), np.float32)
                    r, c = np.nonzero(np.isin(earlier, ids))
                    shared[r, np.searchsorted(ids, earlier[r, c])] = 1
                near &= shared[s : s + step] @ shared[s:].T == 0
            counts[s : s + step] += near @ weight[s:]
            counts[s:] += weight[s : s + step] @ near
        elif some:
            i, j = np.nonzero(near)
            a, b = i + s, j + s
            met = np.zeros(len(a), bool)
            for c in range(earlier.shape[1]):
                own = earlier[a, c]
                met |= (own >= 0) & (earlier[b] == own[:, None]).any(axis=1)
            a, b = a[~met], b[~met]
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
    return counts, labels


def _links(vectors: DataFrame, dim: int, least: float) -> DataFrame:
    """(node, n, other): n links of the node found in a leaf, or an edge from
    it to another node (n 0).  ``vectors``: node, v (valid, of one length), weight."""
    n = vectors.count()
    sample = smallest(vectors.select("node", "v"), F.xxhash64("node"), ["node"], SAMPLE).toPandas()
    x = _unit(np.array(sample["v"].tolist()))
    depth = max(0, int(np.ceil(np.log2(max(1, min(n / LEAF, len(x) / SAMPLED_LEAF))))))
    rng = np.random.default_rng(SEED)
    forest = vectors.sparkSession.sparkContext.broadcast([Tree(x, depth, rng, least) for _ in range(TREES)])

    def fall(batches):
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column(1)))
            found = [(r, k + t * 2 ** (depth + 1)) for t, tree in enumerate(forest.value) for r, k in (tree.leaves(u),)]
            rows, leaf = (np.concatenate(y) for y in zip(*found, strict=True))
            order = np.lexsort((leaf, rows))
            rows, leaf = rows[order], leaf[order]
            ends = np.searchsorted(rows, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf, pa.int32()))], ["node", "v", "weight", "leaves"])

    kind = vectors.schema["v"].dataType.simpleString()
    fallen = written(vectors.select("node", "v", "weight").mapInArrow(fall, f"node long, v {kind}, weight long, leaves array<int>"), "leaves")
    sizes = fallen.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    # Fewer than TREES * 2^(depth + 1) leaves, bounded by the sample.
    parts = sizes.select("leaf", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    met = fallen.withColumn("leaf", F.explode("leaves")).join(F.broadcast(parts), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("leaf", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "v", "weight", "leaves")

    def compare(batches):
        held: list[pa.RecordBatch] = []
        held_key = None

        def done():
            if held:
                t = pa.Table.from_batches(held)
                leaf, p, q = held_key
                column = lambda i: t.column(i).combine_chunks()
                node, lists = column(4).to_numpy(), column(7)
                lengths = np.diff(lists.offsets.to_numpy())
                leaves = np.full((len(node), lengths.max()), -1, np.int64)
                leaves[np.repeat(np.arange(len(node)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
                counts, labels = leaf_links(_unit(_matrix(column(5))), column(6).to_numpy(), column(3).to_numpy(), leaves, leaf, p != q, least)
                some, joined = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[some], node[joined]))), pa.array(np.concatenate((counts[some], np.zeros(len(joined), np.int64)))), pa.array(np.concatenate((node[some], node[labels[joined]])))], ["node", "n", "other"])

        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[s].tolist())
                if key != held_key:
                    yield from done()
                    held, held_key = [], key
                held.append(b.slice(s, e - s))
        yield from done()

    return met.repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q").mapInArrow(compare, "node long, n long, other long")


def near_duplicates(df: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    v = F.col("v")
    rows = written(df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.monotonically_increasing_id().alias("rid")), "vectors")
    valid = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    distinct = written(rows.where(valid).groupBy("v").agg(F.min("rid").alias("node"), F.count("*").alias("weight")), "vectors-distinct")
    found = None
    for (dim,) in sorted(distinct.select(F.size("v")).distinct().collect()):
        part = _links(distinct.where(F.size("v") == dim), dim, least)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "vector-links")
    groups = connected_components(found.where("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    nodes = distinct.join(counts, "node", "left").join(groups, "node", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("label"))
    # Rows that link with nothing keep a label of their own.
    labelled = rows.join(nodes, "v", "left").select("vec_id", "rid", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "rid").alias("label"))
    least_id = labelled.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    return labelled.join(least_id, "label").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embeddings(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
