"""Change-based shipping on Structured Streaming.

Counting runs in Spark's own streaming aggregation (JVM state, checkpointed).
In update mode a micro-batch emits the cells that changed with their running
counts; a cell's shipped part, floor(n / T) * T, is written under the batch's
id.  A batch that runs twice overwrites itself, and shipped parts only grow,
so the parent is their maximum for each worker, summed: recovery needs nothing
beyond the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SummaryConfig
from ..functions.hashing import with_worker
from ..operators.cardinality import register_items
from ..operators.frequency import cm_items
from .control import ThresholdController


class CellStream:
    """A running query that keeps cells under ``path``."""

    def __init__(self, path: str, cells: list[str], value: str, merge: Callable):
        self.path, self.cells, self.value, self.merge = path, cells, value, merge

    def sink(self, shipped: Callable[[], object]):
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.select("worker", *self.cells, shipped().alias(self.value)).where(F.col(self.value) > 0).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

        return write

    def parent(self, spark: SparkSession) -> DataFrame:
        """The parent's cells so far."""
        latest = spark.read.parquet(self.path).groupBy("worker", *self.cells).agg(F.max(self.value).alias(self.value))
        return latest.groupBy(*self.cells).agg(self.merge(self.value).alias(self.value))


def start_cm(stream: DataFrame, cfg: SummaryConfig, path: str, checkpoint: str, controller: ThresholdController | None = None, **trigger):
    """Count-Min in change mode over a stream of ``key``."""
    out = CellStream(path, ["row", "pos"], "value", F.sum)
    counts = cm_items(with_worker(stream, cfg.workers), cfg, ("worker",)).groupBy("worker", "row", "pos").agg(F.count("*").alias("n"))

    def shipped():
        t = controller.threshold if controller else cfg.threshold
        return (F.floor(F.col("n") / t) * t).cast("long")

    return out, counts.writeStream.outputMode("update").foreachBatch(out.sink(shipped)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_registers(stream: DataFrame, cfg: SummaryConfig, path: str, checkpoint: str, **trigger):
    """HyperLogLog or LogLog registers over a stream of ``key``: every improvement ships."""
    out = CellStream(path, ["pos"], "rank", F.max)
    best = register_items(with_worker(stream, cfg.workers), cfg, ("worker",)).groupBy("worker", "pos").agg(F.max("rank").alias("n"))
    return out, best.writeStream.outputMode("update").foreachBatch(out.sink(lambda: F.col("n"))).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
