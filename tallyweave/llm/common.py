"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, or one like it that no column of ``df`` has (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a few keys and numbers that are broadcast at most (some 10 MB).
MOST_SENT = 200_000


def beside(few: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast if it is small, dealt by its keys if not."""
    return F.broadcast(few) if few.count() <= MOST_SENT else few


def smallest(df: DataFrame, draw: Column, then: list[str], k: int) -> DataFrame:
    """The ``k`` rows with the smallest ``draw`` (evenly spread over all 64-bit
    integers), ties by ``then``.  Rows of a larger draw than these can have
    stay where they are, so about 2 k rows meet in one task, however many there are."""
    n = df.count()
    share = (2 * k + 1000) / max(n, 1)
    few = df.where(draw < F.lit(int(-(1 << 63) + share * (1 << 64)))) if share < 0.99 else df
    if share < 0.99 and few.count() < k:
        few = df
    return few.orderBy(draw, *then).limit(k)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset (a single-machine session, as in tests) a
    temporary folder is made and set for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="tallyweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyweave_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing needs any more."""
    jvm, path = df.sparkSession._jvm, df._tallyweave_path
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Plans made inside hand at most ``rows`` rows to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of steps whose results are
    written.  It follows the driver's garbage collection: the first round frees
    what Python holds of the plans, the second the plans' shuffles."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def frugal(f):
    """``f`` over batches, returning freed memory to the system after each:
    workers live on and would otherwise keep their largest task's peak."""

    def run(batches):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        pool = pa.default_memory_pool()
        for out in f(batches):
            yield out
            del out
            pool.release_unused()
            if trim:
                trim(0)

    return run


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, byte by byte: planes of zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    p = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :width] = p.T
    return out.view(np.uint64).ravel()
