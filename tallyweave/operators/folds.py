"""Summaries whose cells depend on arrival order, as sorted streams.

Rows are dealt by group and sorted inside their partition by Spark (which
spills); a fold then walks them once, keeping one group's state.  Nothing is
collected into a list, so a group may be larger than memory.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYED, HEAVY, HeavyConfig, SummaryConfig
from ..functions.hashing import LIGHT_SEED, hash_key, hash_value
from .topk import top_k


def fold_sorted(df: DataFrame, groups: list[str], order: list[str], columns: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """``start(group) -> state``; ``step(state, *columns)`` and ``finish(state)``
    yield output rows; all rows of a group come in order."""
    n = len(groups)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        names = [c.split()[0] for c in schema.split(",")]
        for b in batches:
            out: list = []
            for row in zip(*(b[c].tolist() for c in groups + columns), strict=True):
                if row[:n] != now:
                    if state is not None:
                        out.extend(finish(state))
                    now, state = row[:n], start(row[:n])
                out.extend(step(state, *row[n:]))
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None and (out := list(finish(state))):
            yield pd.DataFrame(out, columns=names)

    keys = list(dict.fromkeys(groups + order))
    return df.select(*dict.fromkeys(keys + columns)).repartition(*groups).sortWithinPartitions(*keys).mapInPandas(walk, schema)


def _none(*_):
    return ()


# Count and universal summary, change mode ---------------------------------------------------------------------------


def signed_deltas(items: DataFrame, groups: list[str], order: list[str], threshold: int, flush: bool = False, strict: bool = False) -> DataFrame:
    """What cells ship of a walk of +1 and -1: a cell that reaches ``threshold``
    (``strict``: exceeds it) in the direction of its latest step ships its
    value and starts anew.  (groups..., value) a shipment."""
    threshold += strict

    def start(group):
        return [group, 0]

    def step(state, sign):
        state[1] += sign
        if state[1] * sign >= threshold:
            yield (*state[0], state[1])
            state[1] = 0

    def finish(state):
        if flush and state[1]:
            yield (*state[0], state[1])

    return fold_sorted(items, groups, order, ["sign"], start, step, finish, ", ".join(f"{g} int" for g in groups) + ", value long")


# Two candidate cells for each key --------------------------------------------------------------------------------


class KeyedCells:
    """One worker's key-carrying cells; replacement draws from a generator seeded by the worker."""

    def __init__(self, worker: int):
        self.worker, self.cells, self.rng = worker, ({}, {}), random.Random(worker)

    def add(self, key: int, pos: tuple[int, int], weight: int = 1) -> tuple[int, int]:
        """Count ``key``; returns the (array, position) that took it."""
        for i in (0, 1):
            cell = self.cells[i].get(pos[i])
            if cell and cell[0] == key:
                cell[1] += weight
                return i, pos[i]
        counts = [self.cells[i].get(pos[i], (0, 0))[1] for i in (0, 1)]
        i = int(counts[0] > counts[1])
        cell = self.cells[i].setdefault(pos[i], [key, 0])
        cell[1] += weight
        if self.rng.random() * cell[1] < weight:
            cell[0] = key
        return i, pos[i]


def _keyed_positions(df: DataFrame, cfg: SummaryConfig) -> DataFrame:
    h = hash_key(df, "key", {"_h": 0})
    return h.withColumns({"p0": (F.col("_h").bitwiseAND(F.lit(0xFFFF)) % cfg.length).cast("int"), "p1": (F.shiftright("_h", 16) % cfg.length).cast("int")}).drop("_h")


_KEYED = "worker int, row int, pos int, key long, value long"


def _keyed_rows(state: KeyedCells):
    return [(state.worker, i, p, k, v) for i in (0, 1) for p, (k, v) in state.cells[i].items() if v]


def keyed_build(df: DataFrame, order: list[str], cfg: SummaryConfig = KEYED) -> DataFrame:
    """(worker, row, pos, key, value): each worker's cells.  ``df``: key, worker, order columns."""

    def step(state, key, p0, p1):
        state.add(key, (p0, p1))
        return ()

    return fold_sorted(_keyed_positions(df, cfg), ["worker"], order, ["key", "p0", "p1"], lambda g: KeyedCells(g[0]), step, _keyed_rows, _KEYED)


def keyed_merge(cells: DataFrame) -> DataFrame:
    """Cells of several summaries as one: counters add up, and of the keys one
    stays with a chance proportional to its counter (exponential races, drawn
    from a hash of key and cell)."""
    u = (F.pmod(F.xxhash64("key", "row", "pos"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return cells.groupBy("row", "pos", "key").agg(F.sum("value").alias("value")).groupBy("row", "pos").agg(F.min_by("key", -F.ln(u) / F.col("value")).alias("key"), F.sum("value").alias("value"))


def keyed_query(cells: DataFrame) -> DataFrame:
    """(key, est): a key that holds two cells gets their sum; empty cells hold none."""
    return cells.groupBy("key").agg(F.sum("value").cast("int").alias("est"))


def keyed_deltas(df: DataFrame, order: list[str], threshold: int, cfg: SummaryConfig = KEYED, strict: bool = False) -> DataFrame:
    """(worker, n, key, value): shipments in each worker's order, at the
    threshold (``strict``: above it).  The key stays in the cell."""
    threshold += strict

    def start(group):
        state = KeyedCells(group[0])
        state.sent = 0
        return state

    def step(state, key, p0, p1):
        i, p = state.add(key, (p0, p1))
        cell = state.cells[i][p]
        if cell[1] >= threshold:
            yield state.worker, state.sent, cell[0], cell[1]
            state.sent += 1
            cell[1] = 0

    return fold_sorted(_keyed_positions(df, cfg), ["worker"], order, ["key", "p0", "p1"], start, step, _none, "worker int, n long, key long, value long")


def keyed_apply(deltas: DataFrame, cfg: SummaryConfig = KEYED, shards: int = 16) -> DataFrame:
    """The parent's cells from shipments, in order of (n, worker).  Shipments
    are dealt by key over parents that are merged like any summaries."""
    at = _keyed_positions(deltas, cfg).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def step(state, key, value, p0, p1):
        state.add(key, (p0, p1), value)
        return ()

    return keyed_merge(fold_sorted(at, ["shard"], ["n", "worker"], ["key", "value", "p0", "p1"], lambda g: KeyedCells(g[0]), step, _keyed_rows, _KEYED))


# Heavy buckets beside a light array -------------------------------------------------------------------------------


class Bucket:
    """Slots [key, count] and the votes against them."""

    def __init__(self, group, slots: int):
        self.group, self.slots, self.vote, self.room = group, [], 0, slots

    def add(self, key: int, weight: int = 1, keep_zero: bool = False):
        """Count ``key``; yields (key, amount) that go to the light array.
        ``keep_zero``: a slot emptied by a shipment keeps its key until evicted."""
        for s in self.slots:
            if s[0] == key:
                s[1] += weight
                return
        if not keep_zero:
            free = next((s for s in self.slots if s[1] == 0), None)
            if free:
                free[:] = [key, weight]
                return
        if len(self.slots) < self.room:
            self.slots.append([key, weight])
            return
        least = min(self.slots, key=lambda s: s[1])
        if self.vote + weight >= least[1] * 8:
            self.vote = 0
            if least[1]:
                yield least[0], least[1]
            least[:] = [key, weight]
        else:
            self.vote += weight
            yield key, weight


def _bucketed(df: DataFrame, cfg: HeavyConfig) -> DataFrame:
    return hash_key(df, "key", {"_h": 0}).withColumn("bucket", (F.col("_h") % cfg.buckets).cast("int")).drop("_h")


def light_cells(light: DataFrame, cfg: HeavyConfig = HEAVY) -> DataFrame:
    """(pos, value) of (key, value) that went to the light array."""
    return hash_key(light.groupBy("key").agg(F.sum("value").alias("value")), "key", {"_h": LIGHT_SEED}).select((F.col("_h") % cfg.light).cast("int").alias("pos"), "value").groupBy("pos").agg(F.sum("value").alias("value"))


def heavy_build(df: DataFrame, order: list[str], cfg: HeavyConfig = HEAVY, by: tuple = ()) -> DataFrame:
    """(by..., bucket, slot, key, value): the slots of each bucket, and with slot -1 what went to the light array."""
    n = len(by)

    def step(state, key):
        for k, v in state.add(key):
            yield (*state.group, -1, k, v)

    def finish(state):
        return [(*state.group, i, k, v) for i, (k, v) in enumerate(state.slots) if v]

    schema = "".join(f"{b} int, " for b in by) + "bucket int, slot int, key long, value long"
    assert n == len(by)
    return fold_sorted(_bucketed(df, cfg), [*by, "bucket"], order, ["key"], lambda g: Bucket(g, cfg.slots), step, finish, schema)


def heavy_merge(parts: DataFrame, order: list[str], cfg: HeavyConfig = HEAVY) -> DataFrame:
    """Several summaries as one, in the given order: slots are counted into the
    buckets with their weight, light parts stay light."""

    def step(state, key, value):
        for k, v in state.add(key, value):
            yield (*state.group, -1, k, v)

    def finish(state):
        return [(*state.group, i, k, v) for i, (k, v) in enumerate(state.slots) if v]

    schema = "bucket int, slot int, key long, value long"
    heavy = fold_sorted(parts.where("slot >= 0"), ["bucket"], [*order, "slot"], ["key", "value"], lambda g: Bucket(g, cfg.slots), step, finish, schema)
    return heavy.unionByName(parts.where("slot < 0").select("bucket", "slot", "key", "value"))


def heavy_query(parts: DataFrame, cfg: HeavyConfig = HEAVY) -> DataFrame:
    """(key, est): a slot's count and its key's light cell."""
    light = light_cells(parts.where("slot < 0").select("key", "value"), cfg)
    heavy = parts.where("slot >= 0").groupBy("key").agg(F.sum("value").alias("value"))
    at = hash_key(heavy, "key", {"_h": LIGHT_SEED}).withColumn("pos", (F.col("_h") % cfg.light).cast("int"))
    return at.join(light.withColumnRenamed("value", "_light"), "pos", "left").select("key", (F.col("value") + F.coalesce("_light", F.lit(0))).cast("int").alias("est"))


def heavy_deltas(df: DataFrame, order: list[str], threshold: int, cfg: HeavyConfig = HEAVY) -> DataFrame:
    """(worker, bucket, n, heavy, key, value): what each worker ships.  Slots
    and light cells ship at the threshold; a shipped slot keeps its key with
    count zero, so the next other key takes it without a transfer."""

    def start(group):
        state = Bucket(group, cfg.slots)
        state.sent = 0
        return state

    def step(state, key):
        for k, v in state.add(key, keep_zero=True):
            yield (*state.group, state.sent, False, k, v)
            state.sent += 1
        slot = next((s for s in state.slots if s[0] == key), None)
        if slot and slot[1] >= threshold:
            yield (*state.group, state.sent, True, key, slot[1])
            state.sent += 1
            slot[1] = 0

    out = fold_sorted(_bucketed(df, cfg), ["worker", "bucket"], order, ["key"], start, step, _none, "worker int, bucket int, n long, heavy boolean, key long, value long")
    # A light cell gathers increments of any size and ships what it holds once that reaches the threshold.
    light = hash_key(out.where("not heavy"), "key", {"_h": LIGHT_SEED}).withColumn("cell", (F.col("_h") % cfg.light).cast("int"))

    def gather(state, bucket, n, key, value):
        state[1] += value
        if state[1] >= threshold:
            yield (state[0][0], bucket, n, False, key, state[1])
            state[1] = 0

    shipped = fold_sorted(light, ["worker", "cell"], ["n", "bucket"], ["bucket", "n", "key", "value"], lambda g: [g, 0], gather, _none, "worker int, bucket int, n long, heavy boolean, key long, value long")
    return out.where("heavy").unionByName(shipped)


def heavy_apply(deltas: DataFrame, cfg: HeavyConfig = HEAVY) -> DataFrame:
    """The parent's parts from shipments in order of (n, worker)."""
    return heavy_merge(deltas.select("bucket", F.when(F.col("heavy"), F.lit(0)).otherwise(F.lit(-1)).alias("slot"), "key", "value", "n", "worker"), ["n", "worker"], cfg)


def numbered(df: DataFrame, order: list[str], by: str = "worker") -> DataFrame:
    """``df`` with ``n``, the item's number with its worker, from 1."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


__all__ = ["Bucket", "KeyedCells", "keyed_apply", "keyed_build", "keyed_deltas", "keyed_merge", "keyed_query", "heavy_apply", "heavy_build", "heavy_deltas", "heavy_merge", "heavy_query", "fold_sorted", "hash_value", "light_cells", "numbered", "signed_deltas", "top_k"]
