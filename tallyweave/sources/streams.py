"""Key streams from tables and from captured frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import pair_key


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_keys(spark, sf_dir) -> DataFrame:
    """key, and the columns that order arrival."""
    return parquet(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber", "l_suppkey")


PART_ORDER = ["l_orderkey", "l_linenumber", "key", "l_suppkey"]


def user_keys(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")


USER_ORDER = ["event_id"]


def supply_pairs(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_orderkey", "l_linenumber")


def supplier_keys(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"))


def price_samples(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("long").alias("key"))


def keys_of_pairs(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return df.withColumn("key", pair_key(src, dst))


def _number(frame: Column, at: int, width: int) -> Column:
    """Big-endian bytes ``at`` (from 0) of a frame as a number."""
    return F.conv(F.hex(F.substring(frame, at + 1, width)), 16, 10).cast("long")


def tcp_packets(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """(src, dst, src_port, dst_port) of Ethernet frames that hold IPv4 TCP
    packets whole up to the ports; other frames are dropped.  Works on batch
    and streaming tables alike."""
    f = F.col(frame)
    header = (F.conv(F.hex(F.substring(f, 15, 1)), 16, 10).cast("int") % 16) * 4
    parsed = frames.where((F.octet_length(f) >= 38) & (F.hex(F.substring(f, 13, 2)) == "0800") & (F.hex(F.substring(f, 24, 1)) == "06"))
    parsed = parsed.withColumn("_port", header + 14).where(F.octet_length(f) >= F.col("_port") + 4)
    port = lambda off: F.conv(F.hex(f.substr(F.col("_port") + off + 1, F.lit(2))), 16, 10).cast("long")
    return parsed.select(_number(f, 26, 4).alias("src"), _number(f, 30, 4).alias("dst"), port(0).alias("src_port"), port(2).alias("dst_port"))


def spread_over(df: DataFrame, queues: int, *columns: str) -> DataFrame:
    """Deal rows over queues by their columns, as a card's receive-side scaling does."""
    return df.repartition(queues, *columns)
