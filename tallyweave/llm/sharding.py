"""Sharding by sampled splitters.

Rows stand in one order, by the MD5 of their text and then of their id.  A
size-weighted sample of them gives quantile boundaries; rows are dealt into the
ranges between, and ranges that turn out overfull are subdivided by more
boundaries, sampled inside them.  Running sizes inside the ranges plus the
ranges' offsets give each row its exact place in the whole order, from which
the law derives the shard:

* ``bytes``: near-equal sizes, off by at most one row or one small group;
* ``rows``:  counts at most one apart;
* ``key``:   rendezvous hashing of the id; one more shard takes rows only
  into itself.

Equal texts stand together.  Under ``bytes`` a group of equal texts stays in one
shard unless it exceeds ``group_share`` of a shard, in which case it is divided
like any other rows.  The result follows from the order alone, not from the
boundaries.

Null text: size 1, crc32 0, grouped with each other.  Null ids are allowed
(hashed as empty ones, under ``key`` as null).  Repeated rows are separate rows
with slots of their own.  An empty table gives an empty result.  Extra columns
are ignored; only id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

N_SHARDS, GROUP_SHARE = 16, 0.005
#: Sampled rows per range; rows per range aimed at; most ranges (the driver holds their boundaries and sums); times the mean that makes a range overfull.
SAMPLE_PER_RANGE, ROWS_PER_RANGE, MOST_RANGES, OVERFULL = 64, 200_000, 1 << 16, 4


#: A row's place in the order: key (of the text), tie (of the id), rid (of the row).
Place = tuple[int, int, int]
FIRST = (-1, -1)


def splitters(sample: list[Place], n_ranges: int) -> list[Place]:
    """Quantile boundaries: a row belongs right of a boundary that does not
    exceed it.  A boundary falls between groups of equal keys, but for keys so
    heavy that several quantiles hit them."""
    sample = sorted(sample)
    cuts = [sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)] if sample else []
    out: list[Place] = []
    for cut in cuts:
        cut = (cut[0], *FIRST) if not out or out[-1][0] != cut[0] else cut
        if not out or cut > out[-1]:
            out.append(cut)
    return out


def _range_of(bounds: list[Place]):
    keys, ties = (np.array([b[i] for b in bounds], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def find(key: pd.Series, tie: pd.Series, rid: pd.Series) -> pd.Series:
        k, t = key.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        several = np.flatnonzero(high - low > 1)
        for hot in np.unique(k[several]).tolist():  # keys with several boundaries
            rows = several[k[several] == hot]
            a, own = low[rows[0]], ties[low[rows[0]] : high[rows[0]]]
            left, right = (np.searchsorted(own, t[rows], side) for side in ("left", "right"))
            high[rows] = a + right
            for i in rows[right > left].tolist():
                high[i] = bisect_right(bounds, (int(k[i]), int(t[i]), int(rid.iat[i])))
        return pd.Series(high.astype(np.int32))

    return find


def _among(keys: list[int]):
    held = np.array(sorted(keys), np.int64)

    @F.pandas_udf("boolean")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.isin(key.to_numpy(), held))

    return find


def _sample(rows: DataFrame, size: Column, total: int, draws: int) -> list[Place]:
    """About ``draws`` rows drawn by their size: a row's hits are its share of all times the draws."""
    draw = F.pmod(F.xxhash64("rid", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    hits = F.floor(size * F.lit(draws / max(total, 1)) + draw)
    return [(r[0], r[1], r[2]) for r in rows.where(hits > 0).select("key", "tie", "rid", hits.alias("n")).collect() for _ in range(r[3])]


def boundaries(meta: DataFrame, n: int, total: int, n_ranges: int) -> list[Place]:
    """Splitters of ``meta`` (key, tie, rid, size) into ranges of near-equal
    size, of which none is overfull, in bytes or in rows."""
    draws = SAMPLE_PER_RANGE * n_ranges
    bounds = splitters(_sample(meta, F.col("size"), total, draws), n_ranges)
    placed = meta.withColumn("range", _range_of(bounds)("key", "tie", "rid"))
    full = {}
    for r, size, rows in placed.groupBy("range").agg(F.sum("size"), F.count("*")).collect():
        pieces = int(max(size * n_ranges / max(total, 1), rows * n_ranges / max(n, 1)))
        if pieces > OVERFULL:
            full[r] = pieces
    if not full:
        return bounds
    inside = placed.where(_among(list(full))(F.col("range").cast("long")))
    sample = sorted(_sample(inside, F.col("size"), total, draws) + _sample(inside, F.lit(1), n, draws))
    more = []
    for r, pieces in full.items():
        low, high = bounds[r - 1] if r else FIRST, bounds[r] if r < len(bounds) else (1 << 63,)
        more += splitters(sample[bisect_left(sample, low) : bisect_left(sample, high)], 2 * pieces)
    return sorted({*bounds, *more})


def _digits(data: Column) -> Column:
    """60 bits of the MD5."""
    return F.conv(F.substring(F.md5(data), 1, 15), 16, 10).cast("long")


def rendezvous(id_col: str, n: int) -> Column:
    """The shard whose hash with the id is largest."""
    scores = [F.struct(F.xxhash64(F.col(id_col), F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(n)]
    return F.array_max(F.array(*scores))["i"]


def assign_shards(
    df: DataFrame, n_shards: int = N_SHARDS, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text",
    group_share: float = GROUP_SHARE, n_ranges: int | None = None,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard."""
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"unknown law {law!r}")
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    meta = written(
        df.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            _digits(text).alias("key"), _digits(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-meta",
    )
    n, total = meta.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = n_ranges or min(MOST_RANGES, max(n_shards, -(-n // ROWS_PER_RANGE)))
    bounds = boundaries(meta, n, total, n_ranges)
    placed = meta.withColumn("range", _range_of(bounds)("key", "tie", "rid"))
    order, group = Window.partitionBy("range").orderBy("key", "tie", "rid"), Window.partitionBy("range", "key")
    placed = placed.withColumns({"before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "row": F.row_number().over(order) - 1, "group_size": F.sum("size").over(group)})
    placed = placed.withColumn("group_before", F.min("before").over(group))

    # One row for each range (at most MOST_RANGES and their subdivisions).
    sizes = sorted(tuple(r) for r in placed.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
    offsets, b, c = [], 0, 0
    for r, rb, rc in sizes:
        offsets.append((r, b, c))
        b, c = b + rb, c + rc
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("base_b", T.LongType()), T.StructField("base_c", T.LongType())])
    placed = placed.join(F.broadcast(spark.createDataFrame(offsets, schema)), "range").withColumn("group_at", F.col("base_b") + F.col("group_before"))
    parted = sorted({b[0] for b in bounds if b[1:] != FIRST})
    if parted:  # groups in several ranges, fewer than those
        own = placed.where(_among(parted)("key")).groupBy("key").agg(F.sum("size").alias("_size"), F.min(F.col("base_b") + F.col("before")).alias("_at")).collect()
        whole = F.broadcast(spark.createDataFrame([tuple(r) for r in own], "key long, _size long, _at long"))
        placed = placed.join(whole, "key", "left").withColumns({"group_size": F.coalesce("_size", "group_size"), "group_at": F.coalesce("_at", "group_at")})

    grown = F.lit(None).cast("int")
    if law == "bytes":
        small = F.col("group_size") <= F.lit(max(1.0, group_share * total / n_shards))
        middle = F.when(small, F.col("group_at") + F.col("group_size") / 2).otherwise(F.col("base_b") + F.col("before") + F.col("size") / 2)
        shard = F.least(F.lit(n_shards - 1), F.floor(middle * F.lit(n_shards) / F.lit(float(max(total, 1)))))
    elif law == "rows":
        shard = F.floor((F.col("base_c") + F.col("row")) * n_shards / F.lit(max(n, 1)))
    else:
        shard, grown = rendezvous("doc_id", n_shards), rendezvous("doc_id", n_shards + 1)
    placed = placed.withColumns({"shard": shard.cast("int"), "grown_shard": grown})
    inner = Window.partitionBy("range", "shard").orderBy("key", "tie", "rid")
    placed = placed.withColumn("in_range", F.row_number().over(inner) - 1)

    # At most n_shards rows a range.
    counts = sorted(tuple(r) for r in placed.groupBy("shard", "range").count().collect())
    starts, at = [], {}
    for s, r, k in counts:
        starts.append((s, r, at.get(s, 0)))
        at[s] = at.get(s, 0) + k
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("range", T.IntegerType()), T.StructField("first_slot", T.LongType())])
    out = placed.join(F.broadcast(spark.createDataFrame(starts, schema)), ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("first_slot") + F.col("in_range")).alias("slot"), "grown_shard")


def op8_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


def op8_sharding_rows(spark, sf_dir):
    """The same table under the law ``rows``."""
    return assign_shards(table(spark, sf_dir, "documents"), law="rows")


#: The CRC-32 of each byte, by eight steps of the polynomial.
_CRC = "list_transform(range(256), lambda x: x::BIGINT)"
for _ in range(8):
    _CRC = f"list_transform({_CRC}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


def _sql(law: str) -> str:
    digits = lambda c: f"('0x' || substr(md5({c}), 1, 15))::BIGINT"
    middle = f"CASE WHEN gsize <= greatest(1.0, {GROUP_SHARE} * total / {N_SHARDS}) THEN gbefore + gsize / 2 ELSE before + size / 2 END"
    shard = f"least({N_SHARDS - 1}, floor(({middle}) * {N_SHARDS} / total::DOUBLE))" if law == "bytes" else f"floor(nth * {N_SHARDS} / n)"
    return f"""
WITH crc AS (SELECT {_CRC} AS steps),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
meta AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, {digits("text")} AS key, {digits("coalesce(doc_id::VARCHAR, '')")} AS tie,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM docs, crc),
placed AS (SELECT *, sum(size) OVER (ORDER BY key, tie ROWS UNBOUNDED PRECEDING) - size AS before, row_number() OVER (ORDER BY key, tie) - 1 AS nth, sum(size) OVER (PARTITION BY key) AS gsize, sum(size) OVER () AS total, count(*) OVER () AS n FROM meta),
grouped AS (SELECT *, min(before) OVER (PARTITION BY key) AS gbefore FROM placed),
sharded AS (SELECT *, ({shard})::INT AS shard FROM grouped)
SELECT doc_id, size::BIGINT AS size, text_crc32, '{law}' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, NULL::INT AS grown_shard FROM sharded
"""


OP8_SQL, OP8_ROWS_SQL = _sql("bytes"), _sql("rows")
