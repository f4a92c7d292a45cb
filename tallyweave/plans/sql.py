"""The queries in DuckDB SQL, built from the same hash stages as nested SELECTs."""

from __future__ import annotations

import math
from collections.abc import Callable

from ..config import CM, COUNT, DD, REGISTERS, SPREAD, LEVELS, SummaryConfig
from ..functions.hashing import LEVEL_SEED, RANK_SEED, WORKER_SEED, hash_sql, words_sql
from ..operators.quantiles import GAMMA
from ..operators.spread import SCALE

PARTS = "SELECT l_partkey AS key, l_orderkey, l_linenumber, l_suppkey FROM lineitem"
PART_ORDER = "l_orderkey, l_linenumber, key, l_suppkey"
USERS = "SELECT user_id AS key, event_id FROM events"
PAIRS = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"
ORDERED_PAIRS = "SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey, l_linenumber FROM lineitem"
SUPPLIERS = "SELECT l_suppkey AS key FROM lineitem"
PRICES = "SELECT CAST(trunc(l_extendedprice) AS BIGINT) AS key FROM lineitem"


def hashed(source: str, seeds: dict[str, int], column: str = "key", width: int = 8) -> str:
    return hash_sql(source, {n: (words_sql(column, width), s) for n, s in seeds.items()})


def worker(source: str, workers: int) -> str:
    return f"SELECT * EXCLUDE (_w), (_w % {workers})::INT AS worker FROM ({hashed(source, {'_w': WORKER_SEED})})"


def cm_items(source: str, cfg: SummaryConfig = CM, keep: str = "") -> str:
    h = hashed(source, {f"h{r}": r for r in range(cfg.rows)})
    return " UNION ALL ".join(f"SELECT {keep} {r} AS row, (h{r} % {cfg.length})::INT AS pos FROM hashed" for r in range(cfg.rows)).join(("WITH hashed AS (" + h + ") ", ""))


def cm_build(source: str, cfg: SummaryConfig = CM) -> str:
    return f"SELECT row, pos, count(*) AS value FROM ({cm_items(source, cfg)}) GROUP BY ALL"


def cm_query(cells: str, keys: str, cfg: SummaryConfig = CM) -> str:
    joins = " ".join(f"LEFT JOIN c AS c{r} ON c{r}.row = {r} AND c{r}.pos = (k.h{r} % {cfg.length})::INT" for r in range(cfg.rows))
    least = ", ".join(f"coalesce(c{r}.value, 0)" for r in range(cfg.rows))
    return f"WITH c AS ({cells}), k AS ({hashed(keys, {f'h{r}': r for r in range(cfg.rows)})}) SELECT k.key, least({least})::INT AS est FROM k {joins}"


def top(sql: str, k: int) -> str:
    return f"SELECT * FROM ({sql}) ORDER BY est DESC, key LIMIT {k}"


def count_items(source: str, cfg: SummaryConfig = COUNT, level: int = 0, keep: str = "") -> str:
    h = hashed(source, {f"h{r}": level * cfg.rows + r for r in range(cfg.rows)})
    return "WITH hashed AS (" + h + ") " + " UNION ALL ".join(f"SELECT {keep} {r} AS row, ((h{r} >> 1) % {cfg.length})::INT AS pos, 1 - 2 * (h{r} & 1)::INT AS sign FROM hashed" for r in range(cfg.rows))


def count_build(source: str, cfg: SummaryConfig = COUNT, level: int = 0) -> str:
    return f"SELECT row, pos, sum(sign)::BIGINT AS value FROM ({count_items(source, cfg, level)}) GROUP BY ALL"


def count_query(cells: str, keys: str, cfg: SummaryConfig = COUNT, level: int = 0) -> str:
    joins = " ".join(f"LEFT JOIN c AS c{r} ON c{r}.row = {r} AND c{r}.pos = ((k.h{r} >> 1) % {cfg.length})::INT" for r in range(3))
    v = [f"(coalesce(c{r}.value, 0) * (1 - 2 * (k.h{r} & 1)::INT))" for r in range(3)]
    return f"WITH c AS ({cells}), k AS ({hashed(keys, {f'h{r}': level * cfg.rows + r for r in range(3)})}) SELECT k.key, greatest(least({v[0]}, {v[1]}), least(greatest({v[0]}, {v[1]}), {v[2]}))::INT AS est FROM k {joins}"


def leveled(source: str, cfg: SummaryConfig = LEVELS) -> str:
    return f"SELECT * EXCLUDE (_l), least({cfg.levels - 1}, 32 - CASE WHEN _l = 0 THEN 0 ELSE length(bin(_l)) END) AS top FROM ({hashed(source, {'_l': LEVEL_SEED})})"


def levels_build(source: str, cfg: SummaryConfig = LEVELS) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS level, * FROM ({count_build(f'SELECT key FROM ({leveled(source, cfg)}) WHERE top >= {i}', cfg, i)})" for i in range(cfg.levels))


def levels_items(source: str, cfg: SummaryConfig = LEVELS, keep: str = "") -> str:
    """``keep``: columns of the source, each with a comma after it."""
    return " UNION ALL ".join(f"SELECT {i} AS level, * FROM ({count_items(f'SELECT {keep} key FROM ({leveled(source, cfg)}) WHERE top >= {i}', cfg, i, keep)})" for i in range(cfg.levels))


def levels_topk(source: str, cfg: SummaryConfig = LEVELS) -> str:
    def level(i):
        own = f"SELECT key FROM ({leveled(source, cfg)}) WHERE top >= {i}"
        return f"SELECT {i} AS level, * FROM ({top(count_query(count_build(own, cfg, i), f'SELECT DISTINCT key FROM ({own})', cfg, i), cfg.k)})"

    return f"SELECT key, level, est FROM ({' UNION ALL '.join(level(i) for i in range(cfg.levels))}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY level) = 1"


def _rank(h: str, cap: int) -> str:
    return f"least({cap}, 33 - length(bin({h})))::INT"


def registers(source: str, cfg: SummaryConfig = REGISTERS) -> str:
    return f"SELECT (h % {cfg.length})::INT AS pos, max({_rank('r', 31)}) AS rank FROM ({hashed(source, {'h': 0, 'r': RANK_SEED})}) GROUP BY ALL"


def hll(regs: str, cfg: SummaryConfig = REGISTERS) -> str:
    m = cfg.length
    return f"SELECT 0::BIGINT AS key, floor({0.7213 * m / (m + 1.079) * m!r}::DOUBLE / ({m} - count(*) + coalesce(sum(pow(2.0::DOUBLE, -rank)), 0)))::INT AS est FROM ({regs})"


def ll(regs: str, cfg: SummaryConfig = REGISTERS) -> str:
    m = cfg.length
    return f"SELECT 0::BIGINT AS key, floor({0.39701 * m!r}::DOUBLE * pow(2.0::DOUBLE, coalesce(sum(rank), 0)::DOUBLE / {m}))::INT AS est FROM ({regs})"


def dd_build(source: str, cfg: SummaryConfig = DD) -> str:
    return f"SELECT CASE WHEN key >= 1 THEN least({cfg.length - 1}, floor(ln(key::DOUBLE) / {math.log(GAMMA)!r}::DOUBLE))::INT ELSE 0 END AS bucket, count(*) AS value FROM ({source}) GROUP BY ALL"


def dd_query(cells: str) -> str:
    return f"""WITH c AS ({cells}), r AS (SELECT bucket, sum(value) OVER (ORDER BY bucket) AS upto, sum(value) OVER () AS total FROM c)
SELECT i::INT AS permille, floor(2.0::DOUBLE * pow({GAMMA}::DOUBLE, (min(bucket) + 1)::DOUBLE) / {1 + GAMMA!r}::DOUBLE)::INT AS value FROM range(1000) AS p(i) JOIN r ON r.upto * 1000 > i * total GROUP BY i"""


def exact_permille(source: str) -> str:
    return f"""WITH s AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS at, count(*) OVER () AS n FROM ({source}))
SELECT i::INT AS permille, key AS value FROM range(1000) AS p(i) JOIN s ON s.at = i * n // 1000"""


def spread_cells(source: str, cfg: SummaryConfig = SPREAD) -> str:
    h = hash_sql(source, {f"{k}{r}": (words_sql(c, 4), r) for k, c in (("s", "src"), ("d", "dst")) for r in range(cfg.rows)})
    items = " UNION ALL ".join(f"SELECT {r} AS row, (s{r} % {cfg.length})::INT AS pos, (d{r} & 15)::INT AS reg, {_rank(f'd{r}', 15)} AS rank FROM hashed" for r in range(cfg.rows))
    return f"WITH hashed AS ({h}) SELECT row, pos, reg, max(rank) AS rank FROM ({items}) GROUP BY ALL"


def spread_query(cells: str, sources: str, cfg: SummaryConfig = SPREAD, base: int = 0) -> str:
    empty, m = SCALE / (16 * 2.0**-base), cfg.length
    k = hash_sql(sources, {f"s{r}": (words_sql("key", 4), r) for r in range(3)})
    joins = " ".join(f"LEFT JOIN f AS f{r} ON f{r}.row = {r} AND f{r}.pos = (k.s{r} % {m})::INT" for r in range(3))
    v = [f"coalesce(f{r}.e, 0)" for r in range(3)]
    return f"""WITH c AS ({cells}), e AS (SELECT row, pos, {SCALE!r}::DOUBLE / ((16 - count(*)) * {2.0**-base!r}::DOUBLE + sum(pow(2.0::DOUBLE, -greatest({base}, rank)))) AS e FROM c GROUP BY ALL),
d AS (SELECT row, sum(e) + ({m} - count(*)) * {empty!r}::DOUBLE AS total FROM e GROUP BY ALL), f AS (SELECT row, pos, e - (total - e) / {m - 1.0} AS e FROM e JOIN d USING (row)), k AS ({k})
SELECT k.key, trunc(round(greatest(least({v[0]}, {v[1]}), least(greatest({v[0]}, {v[1]}), {v[2]})), 6))::INT AS est FROM k {joins}"""


def pair_worker(source: str, workers: int) -> str:
    return f"SELECT * EXCLUDE (_w), (_w % {workers})::INT AS worker FROM ({hash_sql(source, {'_w': ([*words_sql('src', 4), *words_sql('dst', 4)], WORKER_SEED)})})"


def epochs(source: str, order: str, cfg: SummaryConfig, first: int = 1, dealt: Callable[[str, int], str] | None = None) -> str:
    """``first``: the number of a worker's first item; ``dealt``: how items get their worker."""
    p = cfg.interval * cfg.workers
    n = f"SELECT *, row_number() OVER (PARTITION BY worker ORDER BY {order}) - 1 + {first} AS n, count(*) OVER (PARTITION BY worker) - 1 + {first} AS total, worker * {cfg.interval} AS shift FROM ({(dealt or worker)(source, cfg.workers)})"
    return f"SELECT * EXCLUDE (n, total, shift) FROM ({n}) WHERE total >= shift AND n <= shift + (total - shift) // {p} * {p}"


def additive_change(items: str, cells: str, t: int) -> str:
    return f"SELECT {cells}, sum(n // {t} * {t})::BIGINT AS value FROM (SELECT worker, {cells}, count(*) AS n FROM ({items}) GROUP BY ALL) WHERE n >= {t} GROUP BY ALL"


def signed_change(items: str, cells: str, order: str, t: int) -> str:
    """Cells' walks as lists, folded: a cell that reaches ``t`` in the direction of its step ships."""
    step = f"CASE WHEN (a.v + x.v) * x.v >= {t} THEN {{'v': 0::BIGINT, 'shipped': a.shipped + a.v + x.v, 'n': a.n + 1}} ELSE {{'v': a.v + x.v, 'shipped': a.shipped, 'n': a.n}} END"
    walk = f"list_reduce(list({{'v': sign::BIGINT, 'shipped': 0::BIGINT, 'n': 0::BIGINT}} ORDER BY {order}), lambda a, x: {step}, {{'v': 0::BIGINT, 'shipped': 0::BIGINT, 'n': 0::BIGINT}})"
    return f"SELECT {cells}, sum(w.shipped)::BIGINT AS value FROM (SELECT worker, {cells}, {walk} AS w FROM ({items}) GROUP BY ALL) WHERE w.n > 0 GROUP BY ALL"


def accuracy(truth: str, estimates: str, alpha: float, total: str) -> str:
    return f"""WITH t AS ({truth}), e AS ({estimates}), x AS (SELECT cnt, est, coalesce(cnt > lim, false) AS real, coalesce(est > lim, false) AS said FROM t FULL JOIN e USING (key), (SELECT floor(count(*) * {alpha})::BIGINT AS lim FROM {total}))
SELECT count(*) FILTER (real) AS n_real, count(*) FILTER (said) AS n_est, count(*) FILTER (real AND said) AS n_both,
round(count(*) FILTER (real AND said)::DOUBLE / nullif(count(*) FILTER (real), 0), 6) AS cr, round(count(*) FILTER (real AND said)::DOUBLE / nullif(count(*) FILTER (said), 0), 6) AS pr,
round(sum(abs(cnt - est)) FILTER (real AND said)::DOUBLE / nullif(count(*) FILTER (real AND said), 0), 6) AS aae, round(sum(abs(cnt - est) / cnt::DOUBLE) FILTER (real AND said) / nullif(count(*) FILTER (real AND said), 0), 6) AS are FROM x"""
