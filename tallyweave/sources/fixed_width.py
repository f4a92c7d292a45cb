"""Headerless files of fixed-width little-endian records.

A Python data source whose partitions are byte ranges of whole records, so a
file of any size is read in parallel; bytes after the last whole record are
ignored.  Paths are those of a file system that all executors mount.
"""

from __future__ import annotations

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Layouts: record -> fields.
LAYOUTS = {"keys64": [("key", "<u8")], "samples32": [("key", "<u4")], "packets": [("src", "<u4"), ("dst", "<u4")]}
CHUNK, BATCH = 64 << 20, 1 << 16


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for pattern in options["path"].split(",") for p in glob.glob(pattern.removeprefix("file://")))
        if not self.paths:
            raise FileNotFoundError(options["path"])
        self.kind = np.dtype(LAYOUTS[options.get("layout", "keys64")])
        self.chunk = int(options.get("chunkBytes", CHUNK)) // self.kind.itemsize

    def partitions(self):
        return [_Range(p, i, min(self.chunk, n - i)) for p in self.paths for n in (os.path.getsize(p) // self.kind.itemsize,) for i in range(0, n, self.chunk)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            f.seek(partition.first * self.kind.itemsize)
            left = partition.count
            while left:
                records = np.frombuffer(f.read(min(left, BATCH) * self.kind.itemsize), self.kind)
                left -= len(records)
                columns = [records[n].astype(np.uint64).view(np.int64) for n in self.kind.names]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(self.kind.names))


class FixedWidth(DataSource):
    @classmethod
    def name(cls):
        return "fixed_width"

    def schema(self):
        return ", ".join(f"{n} bigint" for n, _ in LAYOUTS[self.options.get("layout", "keys64")])

    def reader(self, schema):
        return _Reader(self.options)


def read_fixed_width(spark: SparkSession, path: str, layout: str = "keys64", **options) -> DataFrame:
    """Keys keep their 64 bits: those above 2^63 show as negative."""
    spark.dataSource.register(FixedWidth)
    return spark.read.format("fixed_width").option("path", path).option("layout", layout).options(**options).load()


def write_fixed_width(df: DataFrame, path: str, layout: str = "keys64") -> int:
    """Write a small table as one file (fixtures); returns the record count."""
    kind = np.dtype(LAYOUTS[layout])
    with open(path, "wb") as f:
        n = 0
        for row in df.select(*kind.names).toLocalIterator():
            f.write(np.array([tuple(int(v) & (1 << 64) - 1 for v in row)], [(x, "<u8") for x in kind.names]).astype(kind).tobytes())
            n += 1
    return n
