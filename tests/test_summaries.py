import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.config import CM, KEYED, COUNT, DD, HEAVY, REGISTERS, SPREAD, LEVELS
from tallyweave.functions.hashing import hash_value, with_worker
from tallyweave.operators import cardinality, evaluate, exact, folds, frequency, quantiles, spread
from tallyweave.operators.cells import merged_max, merged_sum
from tallyweave.operators.topk import key_slots, slot_bytes, top_k
from tallyweave.plans import modes

rng = random.Random(5)
ITEMS = [min(int(rng.paretovariate(0.7)), 400) for _ in range(3000)]
W, T = 4, 3
SMALL = {"workers": W, "threshold": T, "interval": 100}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(list(enumerate(ITEMS)), "seq long, key long").cache()


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, k % 20, k * i % 300) for i, k in enumerate(ITEMS)], "seq long, src long, dst long").cache()


def rows(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def worker(k):
    return hash_value(k, 101) % W


def test_count_min_bounds_the_truth_and_keeps_the_mass(items):
    cells = frequency.cm_build(items, CM.but(length=64))
    assert {r["row"]: r["n"] for r in cells.groupBy("row").agg(F.sum("value").alias("n")).collect()} == dict.fromkeys(range(3), len(ITEMS))
    truth = Counter(ITEMS)
    assert all(r["est"] >= truth[r["key"]] for r in frequency.cm_query(cells, items.select("key").distinct(), CM.but(length=64)).collect())


def test_count_summary_is_exact_without_collisions(items):
    got = rows(frequency.count_query(frequency.count_build(items), items.select("key").distinct()), "key", "est")
    truth = Counter(ITEMS)
    assert sum(got[(k,)] == n for k, n in truth.items()) > 0.95 * len(truth)


def test_universal_levels_use_their_own_seeds(items):
    cells = rows(frequency.levels_build(items), "level", "row", "pos", "value")
    want = Counter()
    for k in ITEMS:
        top = min(5, 32 - hash_value(k, 199).bit_length())
        for level in range(top + 1):
            for r in range(3):
                h = hash_value(k, 3 * level + r)
                want[level, r, (h >> 1) % 65536] += 1 - 2 * (h & 1)
    assert cells == dict(want)
    got = frequency.levels_query(frequency.levels_build(items), items.select("key").distinct(), LEVELS.but(k=10))
    assert got.count() == got.select("key").distinct().count() >= 10


def test_registers(items):
    cfg = REGISTERS.but(length=64)
    regs = cardinality.register_build(items, cfg)
    want: dict = defaultdict(int)
    for k in ITEMS:
        p = hash_value(k, 0) % 64
        want[p] = max(want[p], min(31, 33 - hash_value(k, 101).bit_length()))
    assert rows(regs, "pos", "rank") == {(p,): r for p, r in want.items()}
    powers = 64 - len(want) + sum(2.0**-r for r in want.values())
    assert cardinality.hll_estimate(regs, cfg).first()["est"] == int(0.7213 * 64 / (64 + 1.079) * 64 / powers)
    assert cardinality.ll_estimate(regs, cfg).first()["est"] == int(0.39701 * 64 * 2 ** (sum(want.values()) / 64))
    n = len(set(ITEMS))
    assert abs(cardinality.hll_estimate(cardinality.register_build(items), corrected=True).first()["est"] - n) < 0.05 * n


def test_quantile_summary_and_truth(items, spark):
    truth = sorted(ITEMS)
    got = rows(quantiles.exact_permille(items, 50), "permille", "value")
    assert got == {(i,): truth[i * len(truth) // 1000] for i in range(1000)}
    est = rows(quantiles.dd_query(quantiles.dd_build(items)), "permille", "value")
    assert len(est) == 1000 and all(abs(v - got[p]) <= 1 + 0.002 * got[p] for p, v in est.items())
    zero = spark.createDataFrame([(0,), (0,)], "key long")
    assert rows(quantiles.dd_build(zero), "bucket", "value") == {(0,): 2}
    assert quantiles.dd_query(quantiles.dd_build(zero.where("false"))).count() == 0
    assert quantiles.rank_report(items).count() == 999
    shares = sorted(r["share"] for r in quantiles.cdf(items.groupBy("key").agg(F.count("*").alias("n")), width=7).collect())
    assert shares[-1] == 1.0 and shares[0] == ITEMS.count(min(ITEMS)) / len(ITEMS)


def _spread_cells(ps, base=0):
    cells: dict = defaultdict(lambda: [base] * 16)
    for s, d in ps:
        for r in range(3):
            h = hash_value(d, r, 4)
            c = cells[r, hash_value(s, r, 4) % 65536]
            c[h & 15] = max(c[h & 15], min(15, 33 - h.bit_length()))
    return cells


@pytest.mark.parametrize("base", [0, 1])
def test_spread_equals_a_plain_computation(pairs, base):
    ps = [(r["src"], r["dst"]) for r in pairs.collect()]
    cells = _spread_cells(ps, base)
    e = {c: 0.673 * 256 / sum(2.0**-x for x in v) for c, v in cells.items()}
    noise = [sum(v for (r, _), v in e.items() if r == row) + (65536 - sum(r == row for r, _ in e)) * 0.673 * 256 / (16 * 2.0**-base) for row in range(3)]
    built = spread.spread_build(pairs) if base == 0 else modes.spread_change(pairs)
    got = rows(spread.spread_query(built, pairs.select(F.col("src").alias("key")).distinct(), SPREAD, base), "key", "est")
    for (s,), est in got.items():
        three = sorted(e[r, hash_value(s, r, 4) % 65536] - (noise[r] - e[r, hash_value(s, r, 4) % 65536]) / 65535 for r in range(3))
        assert est == int(round(three[1], 6))


@pytest.mark.parametrize("build,merge", [(frequency.cm_build, merged_sum), (frequency.count_build, merged_sum), (frequency.levels_build, merged_sum), (cardinality.register_build, merged_max), (quantiles.dd_build, merged_sum)])
def test_merging_halves_equals_the_whole(items, build, merge):
    a, b = items.where("seq % 3 = 0"), items.where("seq % 3 <> 0")
    assert sorted(map(str, merge(build(a), build(b)).collect())) == sorted(map(str, build(items).select(*merge(build(a)).columns).collect()))


def test_additive_change_equals_a_walk(items):
    cfg = CM.but(**SMALL, length=64)
    for strict in (False, True):
        child, parent = Counter(), Counter()
        for k in ITEMS:
            for r in range(3):
                c = (worker(k), r, hash_value(k, r) % 64)
                child[c] += 1
                if child[c] >= T + strict:
                    parent[c[1:]] += child.pop(c)
        assert rows(modes.cm_change(items, cfg, strict), "row", "pos", "value") == dict(parent)
    whole = modes.cm_change(items, cfg.but(flush_residual=True))
    assert rows(whole, "row", "pos", "value") == rows(frequency.cm_build(items, cfg), "row", "pos", "value")
    child, parent = Counter(), Counter()
    for k in ITEMS:
        c = (worker(k), min(65535, int(math.log(k) / math.log(1.001))))
        child[c] += 1
        if child[c] >= T:
            parent[c[1:]] += child.pop(c)
    assert rows(modes.dd_change(items, DD.but(**SMALL)), "bucket", "value") == dict(parent)


def test_signed_change_equals_a_walk(items):
    child, parent = Counter(), Counter()
    for k in ITEMS:
        for r in range(3):
            h = hash_value(k, r)
            c, s = (worker(k), r, (h >> 1) % 64), 1 - 2 * (h & 1)
            child[c] += s
            if child[c] * s >= T:
                parent[c[1:]] += child.pop(c)
    assert rows(modes.count_change(items, ["seq"], COUNT.but(**SMALL, length=64)), "row", "pos", "value") == dict(parent)


def test_periodic_equals_a_walk(items):
    cfg = CM.but(**SMALL, length=64)
    seen, child, parent = Counter(), defaultdict(Counter), Counter()
    for k in ITEMS:
        w = worker(k)
        seen[w] += 1
        for r in range(3):
            child[w][r, hash_value(k, r) % 64] += 1
        if seen[w] % (100 * W) == 100 * w:
            parent += child.pop(w)
    assert rows(modes.periodic(items, ["seq"], cfg, frequency.cm_build), "row", "pos", "value") == dict(parent)


def test_heavy_equals_a_walk_and_keeps_the_mass(items):
    cfg = HEAVY.but(buckets=7, light=32)
    buckets, light = defaultdict(lambda: [[[0, 0] for _ in range(4)], 0]), Counter()
    for k in ITEMS:
        b = buckets[hash_value(k, 0) % 7]
        slot = next((s for s in b[0] if s[0] == k or s[1] == 0), None)
        if slot:
            slot[:] = [k, slot[1] + 1]
            continue
        least = min(b[0], key=lambda s: s[1])
        if b[1] + 1 >= 8 * least[1]:
            b[1] = 0
            light[hash_value(least[0], 101) % 32] += least[1]
            least[:] = [k, 1]
        else:
            b[1] += 1
            light[hash_value(k, 101) % 32] += 1
    parts = folds.heavy_build(items, ["seq"], cfg).cache()
    heavy = {(r["bucket"], r["key"]): r["value"] for r in parts.where("slot >= 0").collect()}
    assert heavy == {(b, k): n for b, (slots, _) in buckets.items() for k, n in slots if n}
    assert rows(folds.light_cells(parts.where("slot < 0").select("key", "value"), cfg), "pos", "value") == {(p,): n for p, n in light.items()}
    merged = folds.heavy_merge(folds.heavy_build(with_worker(items, W), ["seq"], cfg, ("worker",)), ["worker"], cfg)
    assert merged.agg(F.sum("value")).first()[0] == len(ITEMS)


def test_key_carrying_cells_keep_the_mass_and_find_the_heaviest(items):
    cells = folds.keyed_build(with_worker(items, W), ["seq"], KEYED.but(length=64)).cache()
    merged = folds.keyed_merge(cells)
    assert merged.agg(F.sum("value")).first()[0] == len(ITEMS)
    assert merged.groupBy("row", "pos").count().where("count > 1").count() == 0
    heaviest = Counter(ITEMS).most_common(1)[0][0]
    assert top_k(folds.keyed_query(folds.keyed_merge(folds.keyed_build(with_worker(items, W), ["seq"]))), 1).first()["key"] == heaviest
    deltas = folds.keyed_deltas(with_worker(items, W), ["seq"], T)
    shipped = deltas.agg(F.sum("value")).first()[0]
    assert len(ITEMS) - W * 2 * 400 * T < shipped <= len(ITEMS)
    assert folds.keyed_apply(deltas).agg(F.sum("value")).first()[0] == shipped


def test_heavy_change_ships_no_more_than_it_saw(items):
    deltas = folds.heavy_deltas(with_worker(items, W), ["seq"], T, HEAVY.but(buckets=7, light=32))
    shipped = deltas.agg(F.sum("value")).first()[0]
    assert 0.5 * len(ITEMS) < shipped <= len(ITEMS)
    assert folds.heavy_apply(deltas, HEAVY.but(buckets=7, light=32)).agg(F.sum("value")).first()[0] == shipped


def test_top_k_breaks_ties_by_key(spark):
    e = spark.createDataFrame([(3, 5), (1, 5), (2, 9)], "key long, est int")
    assert [r["key"] for r in top_k(e, 2).collect()] == [2, 1]
    assert slot_bytes(key_slots(1600)) == 1600


def test_accuracy_guards_empty_sets(spark):
    truth = spark.createDataFrame([(1, 10), (2, 5)], "key long, cnt long")
    est = spark.createDataFrame([(1, 12), (3, 20)], "key long, est int")
    r = evaluate.accuracy(truth, est, 4).first()
    assert (r["cr"], r["pr"], r["aae"], r["are"]) == (0.5, 0.5, 2.0, 0.2)
    assert evaluate.accuracy(truth, est, 100).first()["aae"] is None
    assert evaluate.report(evaluate.accuracy(truth, est, 4)).startswith("CR: 0.5")
    assert evaluate.threshold(60_000, 0.0002) == 12


def test_exact(items, pairs):
    assert rows(exact.frequency(items), "key", "cnt") == {(k,): n for k, n in Counter(ITEMS).items()}
    assert exact.cardinality(items).first()["cnt"] == len(set(ITEMS))
    ps = {(r["src"], r["dst"]) for r in pairs.collect()}
    assert rows(exact.spread(pairs), "src", "cnt") == {(k,): n for k, n in Counter(s for s, _ in ps).items()}


def test_empty_streams(items):
    none = items.where("false")
    assert frequency.cm_build(none).count() == 0
    assert cardinality.hll_estimate(cardinality.register_build(none, REGISTERS.but(length=64)), REGISTERS.but(length=64)).first()["est"] == int(0.7213 * 64 / (64 + 1.079))
