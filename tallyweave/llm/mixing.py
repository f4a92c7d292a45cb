"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots; a slot serves one block of ``block_rows`` rows of one
source.  A source of weight ``units / period`` has its j-th block (from 0)
released at ``floor(j * period / units)`` and due at
``ceil((j + 1) * period / units)``; in each slot the released block with the
earliest deadline is served (ties: the source first by name).  The units add
up to the period, so every deadline is met and at each slot t a source has
been served less than one block more or less than ``t * weight``.

The schedule repeats after ``period`` slots, so one period is planned, with
SQL functions over an array of the sources' units, and each row finds its
slots by arithmetic.  Rows of a source are taken in the order of md5(id); the
mix lasts until every source has been served whole, sources with more weight
than rows starting over (``epoch`` 1, 2, ...).  No row is left out.

Weights: given by name, or each source's row count to the power ``alpha``
(1: as found, 0: all alike).  Given weights need not add up to 1; a source
without a given weight gets the smallest given one.  Weights are rounded to
``1 / period`` by largest remainder, at least one unit for each source.

The plan of a period is one row's work, period times sources squared steps at most,
so it is meant for sources in the hundreds or thousands, whatever their rows.

Null sources form a source of their own, named '' like an empty one; null ids
sort as ''.  Repeated rows are separate rows.  An empty table gives an empty
result.  Extra columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

PERIOD, BLOCK_ROWS, ALPHA = 1000, 32, 0.7
#: Per-source tables (256 offsets a source) are broadcast up to so many sources.
BROADCAST_SOURCES = 1000

#: One period of earliest-deadline-first over the array ``units``: the place of the source served in each slot.
EDF = """
aggregate(
  sequence(0, cast(period AS int) - 1),
  named_struct('done', transform(units, u -> 0L), 'out', cast(array() AS array<int>)),
  (acc, t) -> transform(
    array(cast(array_min(transform(
      filter(sequence(0, size(units) - 1), i -> acc.done[i] < units[i] AND acc.done[i] * period div units[i] <= t),
      i -> ((acc.done[i] + 1) * period + units[i] - 1) div units[i] * size(units) + i)) % size(units) AS int)),
    c -> named_struct('done', transform(acc.done, (d, i) -> IF(i = c, d + 1, d)), 'out', concat(acc.out, array(c))))[0],
  acc -> acc.out)
"""


def plan(counts: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA) -> DataFrame:
    """A row for each source: its rows, blocks, units, the slots of its blocks
    in a period, and the length of the whole mix.  ``counts``: source, n."""
    if weights:
        least = min(weights.values())
        given = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(float(least)))
    else:
        given = F.pow(F.col("n").cast("double"), F.lit(alpha))
    every, by_name = Window.partitionBy(), Window.orderBy("source")
    s = counts.select("source", "n", given.alias("w")).withColumns({"k": F.count("*").over(every), "share": F.col("w") / F.sum("w").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    # Each source's first unit is its own; the rest are dealt by share.
    s = s.withColumn("period", F.greatest(F.lit(period).cast("long"), F.col("k")))
    s = s.withColumn("due", F.col("share") * (F.col("period") - F.col("k")))
    s = s.withColumns({"whole": F.floor("due"), "rest": F.col("due") - F.floor("due")})
    s = s.withColumn("left", F.col("period") - F.col("k") - F.sum("whole").over(every))
    s = s.withColumn("units", 1 + F.col("whole") + F.when(F.row_number().over(Window.orderBy(F.desc("rest"), "source")) <= F.col("left"), 1).otherwise(0))
    s = s.select("source", "n", "period", "units", (F.row_number().over(by_name) - 1).alias("place"), F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks"))
    served = s.groupBy("period").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "units"))), lambda x: x["units"]).alias("units")).select(F.posexplode(F.expr(EDF)).alias("slot", "place"))
    slots = served.groupBy("place").agg(F.sort_array(F.collect_list(F.col("slot").cast("long"))).alias("slots"))
    s = s.join(slots, "place").withColumn("lasts", F.expr("(blocks - 1) div units * period + slots[cast((blocks - 1) % units AS int)] + 1"))
    return s.withColumn("total", F.max("lasts").over(every)).drop("lasts")


def mix(df: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA, id_col: str = "doc_id", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The mix: doc_id, source, slot, block (its number in the source), place
    (the row's number in the block), epoch; and the columns to ``carry``."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []))
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # A source's rows are numbered in slices of the order, so that a large source spreads over many tasks.
    rows = rows.withColumn("slice", F.substring("order", 1, 2))
    slices = rows.groupBy("source", "slice").agg(F.count("*").alias("c"))
    offsets = slices.select("source", "slice", (F.sum("c").over(Window.partitionBy("source").orderBy("slice")) - F.col("c")).alias("base"))
    sources = plan(slices.groupBy("source").agg(F.sum("c").alias("n")), weights, period, block_rows, alpha)
    keys = Window.partitionBy("source", "slice").orderBy("order", "doc_id")
    small = slices.select("source").distinct().count() <= BROADCAST_SOURCES
    beside = F.broadcast if small else (lambda x: x)
    at = rows.withColumn("nth", F.row_number().over(keys) - 1).join(beside(offsets), ["source", "slice"]).join(beside(sources), "source")
    at = at.withColumn("at", F.col("base") + F.col("nth")).withColumns({"block": F.expr(f"at div {block_rows}"), "place_in": F.expr(f"at % {block_rows}")})
    # Jobs that serve the block: its number, and every ``blocks`` further while the mix lasts.
    at = at.withColumn("epoch", F.explode(F.expr("sequence(0L, (total div period + 1) * units div blocks)"))).withColumn("job", F.expr("epoch * blocks + block"))
    at = at.withColumn("slot", F.expr("job div units * period + slots[cast(job % units AS int)]")).where("slot < total")
    return at.select("doc_id", "source", "slot", "block", F.col("place_in").alias("place"), "epoch", *([F.col("carried")] if carry else []))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` as often as the mix serves them, with its columns."""
    cols = df.columns
    return mix(df, carry=cols, **options).select(*[F.col("carried")[c].alias(c) for c in cols])


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
shares AS (SELECT source, n, count(*) OVER () AS k, pow(n::DOUBLE, {ALPHA}) / sum(pow(n::DOUBLE, {ALPHA})) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS share FROM counts),
dues AS (SELECT *, greatest({PERIOD}, k) AS period, share * (greatest({PERIOD}, k) - k) AS due FROM shares),
ranked AS (SELECT *, period - k - sum(floor(due)) OVER () AS remaining, row_number() OVER (ORDER BY due - floor(due) DESC, source) AS r FROM dues),
src AS (SELECT source, n, period::BIGINT AS period, (1 + floor(due) + CASE WHEN r <= remaining THEN 1 ELSE 0 END)::BIGINT AS units, row_number() OVER (ORDER BY source) AS place, ((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS})::BIGINT AS blocks FROM ranked),
u AS (SELECT list(units ORDER BY place) AS us, any_value(period) AS period, count(*)::BIGINT AS k FROM src),
sched(t, done, pick) AS (
  SELECT 0::BIGINT, list_transform(us, lambda x: 0::BIGINT), 0::BIGINT FROM u
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda i: done[i] + CASE WHEN i = c THEN 1 ELSE 0 END), c
  FROM (SELECT t, done, us, k, list_min(list_transform(list_filter(range(1, k + 1), lambda i: done[i] < us[i] AND done[i] * period // us[i] <= t), lambda i: ((done[i] + 1) * period + us[i] - 1) // us[i] * (k + 1) + i)) % (k + 1) AS c
        FROM sched, u WHERE t < period)),
slots AS (SELECT pick AS place, list(t - 1 ORDER BY t) AS slots FROM sched WHERE t > 0 GROUP BY 1),
planned AS (SELECT src.*, slots, max((blocks - 1) // units * period + slots[(blocks - 1) % units + 1] + 1) OVER () AS total FROM src JOIN slots USING (place)),
numbered AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS nth FROM documents),
served AS (SELECT doc_id, source, nth // {BLOCK_ROWS} AS block, nth % {BLOCK_ROWS} AS place_in, period, units, blocks, slots, total, unnest(range(0, (total // period + 1) * units // blocks + 1)) AS epoch FROM numbered JOIN planned USING (source))
SELECT doc_id, source, (epoch * blocks + block) // units * period + slots[(epoch * blocks + block) % units + 1] AS slot, block, place_in AS place, epoch
FROM served WHERE (epoch * blocks + block) // units * period + slots[(epoch * blocks + block) % units + 1] < total
"""
