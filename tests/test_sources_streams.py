import struct

from pyspark.sql import functions as F

from tallyweave.config import CM, REGISTERS
from tallyweave.operators import cardinality
from tallyweave.plans import modes
from tallyweave.sources.fixed_width import read_fixed_width, write_fixed_width
from tallyweave.sources.streams import spread_over, tcp_packets
from tallyweave.streaming.change import start_cm, start_registers
from tallyweave.streaming.control import Rates, ThresholdController


def test_fixed_width_files(spark, tmp_path):
    keys = [0, 1, 2**32, 2**63 - 1, -1]
    path = str(tmp_path / "keys.bin")
    df = spark.createDataFrame([(k,) for k in keys], "key long").coalesce(1)
    assert write_fixed_width(df, path) == 5
    with open(path, "ab") as f:
        f.write(b"abc")  # a partial record is ignored
    got = read_fixed_width(spark, path, chunkBytes="16")
    assert sorted(r["key"] for r in got.collect()) == sorted(keys)
    assert got.rdd.getNumPartitions() == 3
    with open(path, "wb") as f:
        f.write(struct.pack("<4I", 1, 2, 3, 2**32 - 1))
    assert [tuple(r) for r in read_fixed_width(spark, path, "packets").collect()] == [(1, 2), (3, 2**32 - 1)]
    assert sorted(r["key"] for r in read_fixed_width(spark, path, "samples32").collect()) == [1, 2, 3, 2**32 - 1]


def _frame(ethertype=0x0800, proto=6, options=0, src=0x0A000001, dst=0xC0A80002, ports=(80, 50000)):
    ip = struct.pack(">BBHHHBBHII", 0x45 + options, 0, 0, 0, 0, 64, proto, 0, src, dst) + bytes(4 * options)
    return bytes(12) + struct.pack(">H", ethertype) + ip + struct.pack(">HH", *ports) + bytes(16)


def test_tcp_frames(spark):
    frames = [_frame(), _frame(options=2), _frame(proto=17), _frame(ethertype=0x86DD), b"", _frame()[:36]]
    got = tcp_packets(spark.createDataFrame([(bytearray(f),) for f in frames], "frame binary")).collect()
    assert [tuple(r) for r in got] == [(0x0A000001, 0xC0A80002, 80, 50000)] * 2
    assert spread_over(spark.range(10).withColumnRenamed("id", "src"), 5, "src").rdd.getNumPartitions() == 5


def test_streams_equal_batch(spark, tmp_path):
    data = str(tmp_path / "in")
    for part in range(3):
        spark.range(part * 200, part * 200 + 400).select((F.col("id") % 70).alias("key")).coalesce(1).write.mode("append").parquet(data)
    batch = spark.read.parquet(data)
    stream = spark.readStream.schema("key long").option("maxFilesPerTrigger", 1).parquet(data)
    cfg = CM.but(workers=2, threshold=3, length=64)
    cells, q = start_cm(stream, cfg, str(tmp_path / "cells"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    assert sorted(cells.parent(spark).collect()) == sorted(modes.cm_change(batch, cfg).collect())
    _, again = start_cm(stream, cfg, str(tmp_path / "cells"), str(tmp_path / "cp"))  # a restart has nothing left to do
    again.awaitTermination()
    assert sorted(cells.parent(spark).collect()) == sorted(modes.cm_change(batch, cfg).collect())
    regs, q = start_registers(stream, REGISTERS.but(workers=2), str(tmp_path / "regs"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert sorted(regs.parent(spark).collect()) == sorted(cardinality.register_build(batch).collect())


def test_threshold_control():
    c = ThresholdController()
    assert [c.observe(0) for _ in range(3)] == [7, 7, 7]  # idle: ship sooner, down to the least
    assert c.observe(500) == 8 and c.observe(500) == 9  # backlog: later
    assert c.observe(400) == 9  # shrinking fast: wait
    for _ in range(100):
        c.observe(1000)
    assert c.threshold == 63
    d = ThresholdController()
    assert d.shipped(63, 500) == 8 and d.shipped(1, 500) == 9
    assert d.progress({"inputRowsPerSecond": 10.0, "processedRowsPerSecond": 10.0}) in (8, 9)


def test_rates(spark, tmp_path):
    listener = Rates()
    spark.streams.addListener(listener)
    spark.range(10).write.parquet(str(tmp_path / "r"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "r")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    import time

    for _ in range(50):
        if listener.rates:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.rates and listener.rates[0][1] == 10
