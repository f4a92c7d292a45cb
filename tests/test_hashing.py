import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import hashing, scalars

KEYS = [0, 1, 7, 2**31, 2**32 - 1, 2**32, 2**40 + 3, 2**63 - 1, -1, -(2**63)]


@pytest.mark.parametrize("width", [4, 8])
def test_columns_equal_plain_python(spark, width):
    df = spark.createDataFrame([(k,) for k in KEYS], "key long")
    seeds = {"a": 0, "b": 101, "c": 17, "d": 199}
    for r in hashing.hash_key(df, "key", seeds, width).collect():
        for name, s in seeds.items():
            assert r[name] == hashing.hash_value(r["key"] & (1 << 64) - 1, s, width)


def test_seed_by_row(spark):
    df = spark.range(18).select(F.lit(5).cast("long").alias("key"), F.col("id").alias("i"))
    h = hashing.with_hashes(df, {"h": (hashing.words("key", 8), hashing.seed_at(F.col("i"), 18))})
    assert all(r["h"] == hashing.hash_value(5, r["i"]) for r in h.collect())


def test_raw_seeds(spark):
    df = spark.createDataFrame([(9,)], "key long")
    h = hashing.with_hashes(df, {"h": (hashing.words("key", 8), hashing.KERNEL_SEEDS[0])}, raw_seed=True)
    assert h.first()["h"] == hashing.hash_value(9, hashing.KERNEL_SEEDS[0], raw_seed=True)


def test_sql_equals_plain_python():
    keys = [k for k in KEYS if k >= 0]
    source = "SELECT unnest([" + ",".join(map(str, keys)) + "]::BIGINT[]) AS key"
    sql = hashing.hash_sql(source, {"h": (hashing.words_sql("key"), 3)})
    assert {k: h for k, h in duckdb.sql(f"SELECT key, h FROM ({sql})").fetchall()} == {k: hashing.hash_value(k, 3) for k in keys}


def test_scalars(spark):
    df = spark.createDataFrame([(0,), (1,), (2**31,), (2**32 - 1,), (3,)], "h long")
    assert [r[0] for r in df.select(scalars.rank("h", 31)).collect()] == [31, 31, 1, 1, 31]
    assert df.select(scalars.rank("h", 15)).first()[0] == 15
    row = df.select(scalars.median3(F.lit(3), F.lit(-1), F.lit(2)).alias("m"), scalars.int32(F.lit(-2.7)).alias("n"), scalars.int32(F.lit(2.7)).alias("p"), scalars.pair_key(F.lit(5), F.lit(7)).alias("k")).first()
    assert tuple(row) == (2, -2, 2, 5 + 7 * 2**32)
