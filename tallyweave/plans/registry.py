"""The registered queries of the summary engine and their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..config import CM, KEYED, COUNT, DD, HEAVY, REGISTERS, SPREAD, LEVELS
from ..functions.hashing import hash_key, with_worker
from ..operators import cardinality, evaluate, exact, folds, frequency, quantiles, spread
from ..operators.cells import apply_deltas, merged_max, merged_sum
from ..operators.topk import least_of_top, top_k
from ..sources import streams
from ..sources.streams import PART_ORDER, USER_ORDER
from ..streaming import change
from . import modes, sql

#: Small tables need few workers and low thresholds for anything to be shipped.
SMALL = {"workers": 4, "threshold": 3, "interval": 500}
CM_S, COUNT_S, LEVELS_S, DD_S, REG_S, SPREAD_S = (c.but(**SMALL) for c in (CM, COUNT, LEVELS, DD, REGISTERS, SPREAD))
KEYED_S, HEAVY_S = KEYED.but(**SMALL), HEAVY.but(**SMALL, buckets=97, light=4096)
SPREAD_S = SPREAD_S.but(threshold=1)
HLL = REGISTERS.but(length=256)
#: A key of more than this share of all items is heavy: at sf0.1 about half the suppliers.
ALPHA = 0.001

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql_text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql_text:
            ORACLE_SQL[f.__name__] = sql_text
        return f

    return add


def _keys(df):
    return df.select("key").distinct()


_PARTS, _PART_KEYS = sql.PARTS, f"SELECT DISTINCT key FROM ({sql.PARTS})"


@query(sql.top(sql.cm_query(sql.cm_build(_PARTS), _PART_KEYS), CM.k))
def cm_topk(spark, d):
    counts = exact.frequency(streams.part_keys(spark, d))
    return top_k(frequency.cm_query(frequency.cm_build(counts, weight="cnt"), counts), CM.k)


@query(f"SELECT key, h0::BIGINT AS h0, h101::BIGINT AS h101 FROM ({sql.hashed(_PART_KEYS, {'h0': 0, 'h101': 101})})")
def hash_vectors(spark, d):
    return hash_key(_keys(streams.part_keys(spark, d)), "key", {"h0": 0, "h101": 101})


@query(sql.cm_build(_PARTS))
def cm_cells(spark, d):
    return frequency.cm_build(streams.part_keys(spark, d))


@query(f"SELECT min(est) AS least FROM ({sql.top(sql.cm_query(sql.cm_build(_PARTS), _PART_KEYS), 100)})")
def cm_heap_min(spark, d):
    parts = streams.part_keys(spark, d)
    return least_of_top(frequency.cm_query(frequency.cm_build(parts), _keys(parts)), 100)


@query(sql.cm_build(sql.epochs(_PARTS, sql.PART_ORDER, CM_S)))
def cm_periodic(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, CM_S, frequency.cm_build)


@query(sql.additive_change(sql.cm_items(sql.worker(_PARTS, 4), CM_S, "worker,"), "row, pos", 3))
def cm_change(spark, d):
    return modes.cm_change(streams.part_keys(spark, d), CM_S)


@query(sql.additive_change(sql.cm_items(sql.worker(_PARTS, 4), CM_S, "worker,"), "row, pos", 4))
def cm_change_kernel(spark, d):
    return modes.cm_change(streams.part_keys(spark, d), CM_S, strict=True)


@query(sql.count_build(_PARTS))
def count_cells(spark, d):
    return frequency.count_build(streams.part_keys(spark, d))


@query(sql.top(sql.count_query(sql.count_build(_PARTS), _PART_KEYS), COUNT.k))
def count_topk(spark, d):
    counts = exact.frequency(streams.part_keys(spark, d))
    return top_k(frequency.count_query(frequency.count_build(counts, weight="cnt"), counts), COUNT.k)


@query(sql.count_build(sql.epochs(_PARTS, sql.PART_ORDER, COUNT_S)))
def count_periodic(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, COUNT_S, frequency.count_build)


_USER_SIGNS = sql.count_items(sql.worker(sql.USERS, 4), keep="worker, event_id,")


@query(sql.signed_change(_USER_SIGNS, "row, pos", "event_id", 3))
def count_change(spark, d):
    return modes.count_change(streams.user_keys(spark, d), USER_ORDER, COUNT_S)


@query(sql.signed_change(_USER_SIGNS, "row, pos", "event_id", 4))
def count_change_kernel(spark, d):
    return modes.count_change(streams.user_keys(spark, d), USER_ORDER, COUNT_S, strict=True)


@query(sql.levels_build(_PARTS))
def levels_cells(spark, d):
    return frequency.levels_build(streams.part_keys(spark, d))


@query(sql.levels_topk(_PARTS))
def levels_topk(spark, d):
    counts = exact.frequency(streams.part_keys(spark, d))
    return frequency.levels_query(frequency.levels_build(counts, weight="cnt"), counts)


@query(sql.levels_build(sql.epochs(_PARTS, sql.PART_ORDER, LEVELS_S)))
def levels_periodic(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, LEVELS_S, frequency.levels_build)


@query(sql.signed_change(sql.levels_items(sql.worker(sql.USERS, 4), keep="worker, event_id,"), "level, row, pos", "event_id", 3))
def levels_change(spark, d):
    return modes.levels_change(streams.user_keys(spark, d), USER_ORDER, LEVELS_S)


@query(sql.hll(sql.registers(_PARTS, HLL), HLL))
def hll_estimate(spark, d):
    return cardinality.hll_estimate(cardinality.register_build(streams.part_keys(spark, d), HLL), HLL)


@query(sql.hll(sql.registers(_PARTS)))
def hll_estimate_raw_default(spark, d):
    return cardinality.hll_estimate(cardinality.register_build(streams.part_keys(spark, d)))


@query(sql.ll(sql.registers(_PARTS, HLL), HLL))
def ll_estimate(spark, d):
    return cardinality.ll_estimate(cardinality.register_build(streams.part_keys(spark, d), HLL), HLL)


@query(sql.registers(sql.epochs(_PARTS, sql.PART_ORDER, REG_S)))
def hll_periodic(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, REG_S, cardinality.register_build, merged_max)


@query(sql.ll(sql.registers(sql.epochs(_PARTS, sql.PART_ORDER, REG_S))))
def ll_periodic(spark, d):
    return cardinality.ll_estimate(modes.periodic(streams.part_keys(spark, d), PART_ORDER, REG_S, cardinality.register_build, merged_max))


@query(sql.registers(_PARTS))
def hll_change(spark, d):
    """Every improvement ships, so workers' registers merge to those of one pass."""
    return merged_max(cardinality.register_build(with_worker(streams.part_keys(spark, d), 4), REG_S, ("worker",)).drop("worker"))


@query(sql.ll(sql.registers(_PARTS)))
def ll_change(spark, d):
    return cardinality.ll_estimate(merged_max(cardinality.register_build(with_worker(streams.part_keys(spark, d), 4), REG_S, ("worker",)).drop("worker")))


@query(sql.dd_build(sql.PRICES))
def dd_cells(spark, d):
    return quantiles.dd_build(streams.price_samples(spark, d))


@query(sql.dd_query(sql.dd_build(sql.PRICES)))
def dd_permille(spark, d):
    return quantiles.dd_query(quantiles.dd_build(streams.price_samples(spark, d)))


@query(sql.additive_change(f"SELECT worker, bucket FROM (SELECT *, CASE WHEN key >= 1 THEN least({DD.length - 1}, floor(ln(key::DOUBLE) / {sql.math.log(sql.GAMMA)!r}::DOUBLE))::INT ELSE 0 END AS bucket FROM ({sql.worker(sql.PRICES, 4)}))", "bucket", 3))
def dd_change(spark, d):
    return modes.dd_change(streams.price_samples(spark, d), DD_S)


@query(sql.dd_build(sql.epochs(_PARTS, sql.PART_ORDER, DD_S)))
def dd_periodic(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, DD_S, quantiles.dd_build)


_SOURCES = f"SELECT DISTINCT src AS key FROM ({sql.PAIRS})"


def _sources(df):
    return df.select(F.col("src").alias("key")).distinct()


@query(sql.spread_cells(sql.PAIRS))
def spread_cells(spark, d):
    return spread.spread_build(streams.supply_pairs(spark, d))


@query(sql.top(sql.spread_query(sql.spread_cells(sql.PAIRS), _SOURCES), SPREAD.k))
def spread_topk(spark, d):
    return spread.spread_topk(streams.supply_pairs(spark, d))


@query(sql.top(sql.spread_query(f"SELECT * FROM ({sql.spread_cells(sql.PAIRS)}) WHERE rank > 1", _SOURCES, base=1), SPREAD.k))
def spread_change(spark, d):
    pairs = streams.supply_pairs(spark, d)
    return top_k(spread.spread_query(modes.spread_change(pairs, SPREAD_S), _sources(pairs), SPREAD, base=1), SPREAD.k)


_PAIR_ORDER = "l_orderkey, l_linenumber, src, dst"


@query(sql.spread_cells(sql.epochs(sql.ORDERED_PAIRS, _PAIR_ORDER, SPREAD_S, dealt=sql.pair_worker)))
def spread_periodic(spark, d):
    pairs = modes.pair_worker(streams.supply_pairs(spark, d), SPREAD_S.workers)
    return modes.periodic(pairs, ["l_orderkey", "l_linenumber", "src", "dst"], SPREAD_S, spread.spread_build, merged_max)


# Live bindings number a worker's items from 0 -----------------------------------------------------------------------


@query(sql.cm_build(sql.epochs(_PARTS, sql.PART_ORDER, CM_S, 0)))
def cm_periodic_live(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, CM_S, frequency.cm_build, first=0)


@query(sql.count_build(sql.epochs(_PARTS, sql.PART_ORDER, COUNT_S, 0)))
def count_periodic_live(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, COUNT_S, frequency.count_build, first=0)


@query(sql.levels_build(sql.epochs(_PARTS, sql.PART_ORDER, LEVELS_S, 0)))
def levels_periodic_live(spark, d):
    return modes.periodic(streams.part_keys(spark, d), PART_ORDER, LEVELS_S, frequency.levels_build, first=0)


@query(sql.spread_cells(sql.epochs(sql.ORDERED_PAIRS, _PAIR_ORDER, SPREAD_S, 0, sql.pair_worker)))
def spread_periodic_live(spark, d):
    pairs = modes.pair_worker(streams.supply_pairs(spark, d), SPREAD_S.workers)
    return modes.periodic(pairs, ["l_orderkey", "l_linenumber", "src", "dst"], SPREAD_S, spread.spread_build, merged_max, first=0)


# Unions of two halves' summaries equal the whole's ------------------------------------------------------------------


def _halves(df):
    odd = F.col("key" if "key" in df.columns else "src") % 2 == 1
    return df.where(odd), df.where(~odd)


@query(sql.cm_build(_PARTS))
def union_cm(spark, d):
    return merged_sum(*map(frequency.cm_build, _halves(streams.part_keys(spark, d))))


@query(sql.count_build(_PARTS))
def union_count(spark, d):
    return merged_sum(*map(frequency.count_build, _halves(streams.part_keys(spark, d))))


@query(sql.levels_build(_PARTS))
def union_levels(spark, d):
    return merged_sum(*map(frequency.levels_build, _halves(streams.part_keys(spark, d))))


@query(sql.registers(_PARTS))
def union_hll(spark, d):
    return merged_max(*map(cardinality.register_build, _halves(streams.part_keys(spark, d))))


@query(sql.ll(sql.registers(_PARTS)))
def union_ll(spark, d):
    return cardinality.ll_estimate(merged_max(*map(cardinality.register_build, _halves(streams.part_keys(spark, d)))))


@query(sql.dd_build(sql.PRICES))
def union_dd(spark, d):
    return merged_sum(*map(quantiles.dd_build, _halves(streams.price_samples(spark, d))))


@query(sql.spread_cells(sql.PAIRS))
def union_spread(spark, d):
    return merged_max(*map(spread.spread_build, _halves(streams.supply_pairs(spark, d))))


@query(sql.cm_build(_PARTS))
def cm_apply_deltas(spark, d):
    """A parent that takes the other half's cells as deltas."""
    first, second = _halves(streams.part_keys(spark, d))
    return apply_deltas(frequency.cm_build(first), frequency.cm_build(second))


# Exact answers and accuracy ----------------------------------------------------------------------------------------


@query(f"SELECT key, count(*) AS cnt FROM ({_PARTS}) GROUP BY key")
def exact_freq(spark, d):
    return exact.frequency(streams.part_keys(spark, d))


@query(f"SELECT 0::BIGINT AS key, count(DISTINCT key) AS cnt FROM ({_PARTS})")
def exact_card(spark, d):
    return exact.cardinality(streams.part_keys(spark, d))


@query(sql.exact_permille(sql.PRICES))
def exact_permille(spark, d):
    return quantiles.exact_permille(streams.price_samples(spark, d))


@query(f"SELECT * FROM ({sql.exact_permille(sql.PRICES)}) WHERE permille >= 1")
def rank_report(spark, d):
    return quantiles.rank_report(streams.price_samples(spark, d))


@query("SELECT l_suppkey AS src, count(DISTINCT l_partkey) AS cnt FROM lineitem GROUP BY 1")
def exact_spread(spark, d):
    return exact.spread(streams.supply_pairs(spark, d))


_FREQ = f"SELECT key, count(*) AS cnt FROM ({sql.SUPPLIERS}) GROUP BY key"
_SUPPLIER_KEYS = f"SELECT DISTINCT key FROM ({sql.SUPPLIERS})"


@query(sql.accuracy(_FREQ, sql.top(sql.cm_query(sql.cm_build(sql.SUPPLIERS), _SUPPLIER_KEYS), CM.k), ALPHA, "lineitem"))
def accuracy_cm(spark, d):
    counts = exact.frequency(streams.supplier_keys(spark, d))
    found = top_k(frequency.cm_query(frequency.cm_build(counts, weight="cnt"), counts), CM.k)
    return evaluate.accuracy(counts, found, evaluate.threshold(streams.supplier_keys(spark, d).count(), ALPHA))


@query(sql.accuracy(_FREQ, sql.top(sql.count_query(sql.count_build(sql.SUPPLIERS), _SUPPLIER_KEYS), COUNT.k), ALPHA, "lineitem"))
def accuracy_count(spark, d):
    counts = exact.frequency(streams.supplier_keys(spark, d))
    found = top_k(frequency.count_query(frequency.count_build(counts, weight="cnt"), counts), COUNT.k)
    return evaluate.accuracy(counts, found, evaluate.threshold(streams.supplier_keys(spark, d).count(), ALPHA))


@query(sql.accuracy("SELECT l_suppkey AS key, count(DISTINCT l_partkey) AS cnt FROM lineitem GROUP BY 1", sql.top(sql.spread_query(sql.spread_cells(sql.PAIRS), _SOURCES), SPREAD.k), 0.0001, "lineitem"))
def accuracy_spread(spark, d):
    pairs = streams.supply_pairs(spark, d)
    return evaluate.accuracy(exact.spread(pairs).withColumnRenamed("src", "key"), spread_topk(spark, d), evaluate.threshold(pairs.count(), 0.0001))


@query(f"SELECT key, round(sum(n) OVER (ORDER BY key) / sum(n) OVER ()::DOUBLE, 9) AS share FROM (SELECT key, count(*) AS n FROM ({_PARTS}) GROUP BY key)")
def cdf(spark, d):
    return quantiles.cdf(streams.part_keys(spark, d).groupBy("key").agg(F.count("*").alias("n"))).select("key", F.round("share", 9).alias("share"))


@query(f"SELECT worker, count(*) AS n FROM ({sql.worker(_PARTS, 16)}) GROUP BY worker")
def partition_skew(spark, d):
    return modes.partition_skew(streams.part_keys(spark, d), 16)


@query("SELECT key, count(*) AS cnt FROM (SELECT (l_suppkey::BIGINT & 4294967295) | (l_partkey::BIGINT << 32) AS key FROM lineitem) GROUP BY key")
def pair_keys(spark, d):
    return exact.frequency(streams.keys_of_pairs(streams.supply_pairs(spark, d)))


# Order-dependent summaries ------------------------------------------------------------------------------------------


@query()
def keyed_topk(spark, d):
    users = with_worker(streams.user_keys(spark, d), KEYED_S.workers)
    return top_k(folds.keyed_query(folds.keyed_merge(folds.keyed_build(users, USER_ORDER, KEYED_S))), KEYED.k)


@query()
def keyed_periodic(spark, d):
    handed = modes.epochs(with_worker(streams.user_keys(spark, d), KEYED_S.workers), USER_ORDER, KEYED_S)
    part = handed.withColumn("worker", F.xxhash64("worker", "epoch").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return folds.keyed_query(folds.keyed_merge(folds.keyed_build(part, USER_ORDER, KEYED_S)))


@query()
def keyed_change_kernel(spark, d):
    users = with_worker(streams.user_keys(spark, d), KEYED_S.workers)
    return folds.keyed_query(folds.keyed_apply(folds.keyed_deltas(users, USER_ORDER, KEYED_S.threshold, KEYED_S, strict=True), KEYED_S))


@query()
def keyed_change(spark, d):
    users = with_worker(streams.user_keys(spark, d), KEYED_S.workers)
    return folds.keyed_query(folds.keyed_apply(folds.keyed_deltas(users, USER_ORDER, KEYED_S.threshold, KEYED_S), KEYED_S))


@query()
def heavy_topk(spark, d):
    return top_k(folds.heavy_query(folds.heavy_build(streams.user_keys(spark, d), USER_ORDER, HEAVY_S), HEAVY_S), HEAVY.k)


@query()
def heavy_periodic(spark, d):
    handed = modes.epochs(with_worker(streams.user_keys(spark, d), HEAVY_S.workers), USER_ORDER, HEAVY_S)
    parts = folds.heavy_build(handed, USER_ORDER, HEAVY_S, ("worker", "epoch"))
    return folds.heavy_query(folds.heavy_merge(parts, ["epoch", "worker"], HEAVY_S), HEAVY_S)


@query()
def heavy_change(spark, d):
    users = with_worker(streams.user_keys(spark, d), HEAVY_S.workers)
    return folds.heavy_query(folds.heavy_apply(folds.heavy_deltas(users, USER_ORDER, HEAVY_S.threshold, HEAVY_S), HEAVY_S), HEAVY_S)


# Streams -----------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/{tempfile.mktemp(prefix='stream-', dir='')}" if named else tempfile.mkdtemp(prefix="tallyweave-stream-")


def _part_stream(spark, d):
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d).select(F.col("l_partkey").alias("key"))


@query(ORACLE_SQL["cm_change"])
def cm_stream(spark, d):
    at = _folder(spark)
    cells, running = change.start_cm(_part_stream(spark, d), CM_S, f"{at}/cells", f"{at}/checkpoint")
    running.awaitTermination()
    return cells.parent(spark)


@query(ORACLE_SQL["hll_change"])
def hll_stream(spark, d):
    at = _folder(spark)
    cells, running = change.start_registers(_part_stream(spark, d), REG_S, f"{at}/cells", f"{at}/checkpoint")
    running.awaitTermination()
    return cells.parent(spark)
