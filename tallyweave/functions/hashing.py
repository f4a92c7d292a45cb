"""The 32-bit mixing hash that all summaries use.

Columns are built in stages, one projection after another, so that each step
refers to an attribute; written as one expression, every xor-shift would copy
its argument and the tree would grow beyond what code generation takes.
Products of 32-bit values are split so that they stay within a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = 0xFFFFFFFF
# The hash's multipliers, and seeds by their index.
PRIMES = (2654435761, 246822519, 3266489917, 668265263, 374761393)
SEEDS = {
    0: 181, 1: 5197, 2: 1151, 3: 137, 4: 5569, 5: 7699, 6: 2887, 7: 8753, 8: 9323, 9: 8963, 10: 6053, 11: 8893, 12: 9377, 13: 6577, 14: 733, 15: 3527, 16: 3881, 17: 6857,
    101: 523, 199: 5591, 201: 6337, 202: 8191,
}
KERNEL_SEEDS = (8017, 3593, 1427)

WORKER_SEED, RANK_SEED, LIGHT_SEED, LEVEL_SEED = 101, 101, 101, 199


def words(column: str | Column, width: int) -> list[Column]:
    """The 32-bit words of a key of ``width`` bytes (4 or 8), low word first."""
    c = (F.col(column) if isinstance(column, str) else column).cast("long")
    low = c.bitwiseAND(F.lit(M))
    return [low] if width == 4 else [low, F.shiftrightunsigned(c, 32)]


def _times(c: Column, by: int) -> Column:
    high = (c * F.lit(by >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return (c * F.lit(by & 0xFFFF) + high).bitwiseAND(F.lit(M))


def seed_at(index: Column, most: int) -> Column:
    """The seed at an index that varies by row, below ``most``."""
    return F.element_at(F.array(*[F.lit(SEEDS[i]).cast("long") for i in range(most)]), (index + 1).cast("int"))


def with_hashes(df: DataFrame, hashes: dict[str, tuple[list[Column], int | Column]], raw_seed: bool = False) -> DataFrame:
    """``df`` with a column for each hash: name -> (words, seed index, or a
    column that gives the seed itself)."""
    w = {f"_{n}_{i}": c for n, (cs, _) in hashes.items() for i, c in enumerate(cs)}
    df = df.withColumns(w)
    seed = {n: s if raw_seed or isinstance(s, Column) else SEEDS[s] for n, (_, s) in hashes.items()}
    count = {n: len(cs) for n, (cs, _) in hashes.items()}
    df = df.withColumns({n: seed[n] + F.lit(4 * count[n] + PRIMES[4]) if isinstance(seed[n], Column) else F.lit((seed[n] + 4 * count[n] + PRIMES[4]) & M).cast("long") for n in hashes})
    for i in range(max(count.values())):
        now = [n for n in hashes if i < count[n]]
        df = df.withColumns({n: (F.col(n) + _times(F.col(f"_{n}_{i}"), PRIMES[2])).bitwiseAND(F.lit(M)) for n in now})
        df = df.withColumns({n: (F.shiftleft(n, 17).bitwiseAND(F.lit(M))).bitwiseOR(F.shiftright(n, 15)) for n in now})
        df = df.withColumns({n: _times(F.col(n), PRIMES[3]) for n in now})
    for shift, prime in ((15, PRIMES[1]), (13, PRIMES[2]), (16, None)):
        df = df.withColumns({n: F.col(n).bitwiseXOR(F.shiftright(n, shift)) for n in hashes})
        if prime:
            df = df.withColumns({n: _times(F.col(n), prime) for n in hashes})
    return df.drop(*w)


def hash_key(df: DataFrame, column: str, seeds: dict[str, int], width: int = 8) -> DataFrame:
    """``with_hashes`` of one key column under several seeds: name -> seed index."""
    return with_hashes(df, {n: (words(column, width), s) for n, s in seeds.items()})


def with_worker(df: DataFrame, workers: int, column: str = "key") -> DataFrame:
    """``df`` with the worker that takes each key."""
    return hash_key(df, column, {"_w": WORKER_SEED}).withColumn("worker", (F.col("_w") % workers).cast("int")).drop("_w")


def hash_value(key: int, seed: int = 0, width: int = 8, raw_seed: bool = False) -> int:
    """The hash of one key (for tests, and folds that hash evicted keys)."""
    h = ((seed if raw_seed else SEEDS[seed]) + width + PRIMES[4]) & M
    for i in range(width // 4):
        h = (h + (key >> 32 * i & M) * PRIMES[2]) & M
        h = ((h << 17 | h >> 15) & M) * PRIMES[3] & M
    h = (h ^ h >> 15) * PRIMES[1] & M
    h = (h ^ h >> 13) * PRIMES[2] & M
    return h ^ h >> 16


def hash_sql(source: str, hashes: dict[str, tuple[list[str], int]]) -> str:
    """The same as nested SELECTs for DuckDB: name -> (words as UBIGINT, seed index)."""
    steps = lambda sql, exprs: f"SELECT * EXCLUDE ({', '.join(exprs)}), {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM ({sql})"
    names = list(hashes)
    sql = f"SELECT *, {', '.join(f'({(SEEDS[s] + 4 * len(w) + PRIMES[4]) & M})::UBIGINT AS {n}' for n, (w, s) in hashes.items())} FROM ({source})"
    for i in range(max(len(w) for w, _ in hashes.values())):
        now = [n for n in names if i < len(hashes[n][0])]
        sql = steps(sql, {n: f"(({n} + (({hashes[n][0][i]}) * {PRIMES[2]}::UBIGINT) & {M}::UBIGINT) & {M}::UBIGINT)" for n in now})
        sql = steps(sql, {n: f"(((({n} << 17) & {M}::UBIGINT) | ({n} >> 15)) * {PRIMES[3]}::UBIGINT) & {M}::UBIGINT" for n in now})
    for shift, prime in ((15, PRIMES[1]), (13, PRIMES[2]), (16, 1)):
        sql = steps(sql, {n: f"(xor({n}, {n} >> {shift}) * {prime}::UBIGINT) & {M}::UBIGINT" for n in names})
    return sql


def words_sql(expr: str, width: int = 8) -> list[str]:
    low = f"(({expr})::BIGINT & {M})::UBIGINT"
    return [low] if width == 4 else [low, f"((({expr})::BIGINT >> 32) & {M})::UBIGINT"]
