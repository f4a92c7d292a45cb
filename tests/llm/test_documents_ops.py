import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, graph, licences, mixing, quality, sharding, simhash, suffix_dedup

from .fixtures import documents, frame

ROWS, PASSAGE = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def components(nodes, linked):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


# Repeated strings ---------------------------------------------------------------------------------------------------


def removed(rows, length):
    """(id, text) -> bytes kept, by looking up every string."""
    first = {}
    rank = lambda i: (i is None, i or 0)
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w not in first or rank(i) < first[w]:
                first[w] = rank(i)
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank(i):
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("many", [10_000, 1])
def test_repeats_equal_brute_force(docs, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    got = suffix_dedup.remove_repeats(docs, with_text=True).collect()
    assert sorted(map(str, (tuple(r)[:5] + (bytes(r["kept"]),) for r in got))) == sorted(map(str, removed(ROWS, 50)))


def test_repeats_with_unique_ids(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ab ") for _ in range(500))
    rows = []
    for i in range(40):
        a, b = rng.randint(0, 400), rng.randint(30, 200)
        rows.append((i * 3, base[a : a + b] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + base[b : b + a // 2]))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(x[:5] for x in removed(rows, 50))


def test_repeats_of_an_empty_table(docs):
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcd ") for _ in range(50))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 90))) + shared + bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 90))) for _ in range(20)]
    h, _, text, at = suffix_dedup.anchors(texts)
    inside = defaultdict(set)
    for g, t, p in zip(h.tolist(), text.tolist(), at.tolist()):
        s = texts[t].index(shared)
        if s <= p <= s + 26:
            inside[t].add((g, p - s))
    assert len(set.intersection(*inside.values())) >= 1 and len(inside) == 20


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_a_long_text_has_the_same_anchors_in_blocks(most):
    rng = random.Random(2)
    for alphabet in (b"ab", b"abcdefgh "):
        for _ in range(40):
            text = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 600)))
            h, c, _, at = suffix_dedup.anchors([text])
            got = [x for g, d, p in suffix_dedup.long_anchors(text, most=most) for x in zip(g.tolist(), d.tolist(), p.tolist())]
            assert set(got) == set(zip(h.tolist(), c.tolist(), at.tolist()))


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    rng = random.Random(5)
    shared = "".join(rng.choice("abc ") for _ in range(2000))
    prose = lambda k: "".join(rng.choice("abcdefg ") for _ in range(k))
    rows = [(i, prose(rng.randint(0, 900)) + shared[rng.randint(0, 700) : rng.randint(800, 2000)] + prose(rng.randint(0, 900))) for i in range(12)] + [(20, None), (21, ""), (22, shared)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(x[:5] for x in removed(rows, 50))


@pytest.mark.parametrize("length", [20, 256])
def test_lengths_beyond_a_byte_are_refused(spark, length):
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=length)


# Decontamination ----------------------------------------------------------------------------------------------------

BENCHMARK = [("i1", PASSAGE), ("i2", "X"), ("i3", None), ("i4", " ,;. "), ("i1", PASSAGE), (None, "no id at all no id"), ("i5", ROWS[1][1] + " elsewhere")]


def contaminated(rows, items, n=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add("null" if i is None else i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 400])
@pytest.mark.parametrize("segment", [2 << 20, 300])
def test_decontamination_equals_brute_force(spark, docs, monkeypatch, block, segment):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "PLACES", segment)
    monkeypatch.setattr(decontaminate, "REACH", 12)
    bench = spark.createDataFrame([(i, t, "extra") for i, t in BENCHMARK], "item_id string, text string, doc_id string")
    got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, contaminated(ROWS, BENCHMARK)))
    if block > 400:
        assert decontaminate.contamination(docs.where("false"), bench).count() == 0
        assert decontaminate.contamination(docs, bench.where("false")).where("contaminated or n_items > 0").count() == 0


def test_decontaminated_rows_keep_their_columns(spark, docs):
    bench = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    more = docs.selectExpr("*", "1 AS _row", "2 AS _text", "3 AS _n_hit", "true AS _contaminated", "4 AS ids")
    left = decontaminate.decontaminated(more, bench)
    assert left.columns == more.columns
    assert left.count() == sum(not c[-1] for c in contaminated(ROWS, BENCHMARK))


def words_of(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


@pytest.mark.parametrize("segment", [2 << 20, 200])
def test_matches_equal_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200)))) for i in range(30)] + [(None, "a b"), (4, None)]
    items = [("p", "a b c"), ("q", "h h"), (None, "c d"), ("r", "zz a"), ("s", "")]
    segments = decontaminate.index(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {tuple(r) for r in decontaminate.phrase_matches(segments, bench).collect()}
    want = {(i, k, p) for i, t in rows for k, q in items for w, v in [(words_of(t), words_of(q))] if v for p in range(len(w) - len(v) + 1) if w[p : p + len(v)] == v}
    assert got == want
    if segment > 200:
        near = {tuple(r)[:2] for r in decontaminate.near_matches(segments, bench, 3).collect()}
        close = {(i, k) for i, t in rows for k, q in items for w, v in [(words_of(t), set(words_of(q)))] if v and any(all(any(w[j] == x for j in range(max(0, p - 3), min(len(w), p + 4))) for x in v) for p in range(len(w)) if w[p] in v)}
        assert near <= close and {x for x in close if x[1] != "p"} <= near  # of three words, the rarest has to be amid the others


def test_proximity(spark):
    texts = spark.createDataFrame([(1, "One two three"), (2, "one x x x two"), (3, "two, one"), (4, "one"), (5, "two x one x two")], "doc_id long, text string")
    segments = decontaminate.index(texts)
    bench = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    got = {w: sorted((r["doc_id"], r["place"]) for r in decontaminate.near_matches(segments, bench, w).collect()) for w in (1, 2, 4)}
    assert {w: {i for i, _ in x} for w, x in got.items()} == {1: {1, 3}, 2: {1, 3, 5}, 4: {1, 2, 3, 5}}
    assert got[2] == [(1, 0), (3, 1), (5, 2)]


# SimHash ------------------------------------------------------------------------------------------------------------


def fingerprint(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups_equal_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    fps = [(i, fingerprint(t, 4)) for i, t in ROWS]
    group = components({f for _, f in fps}, [(a, b) for _, a in fps for _, b in fps if (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in fps:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, f"{f:016x}", least.get(group[f]))) for i, f in fps)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("part,crowd", [(1024, 16_384), (8, 16_384), (8, 1)])
def test_index_links_like_brute_force(spark, monkeypatch, part, crowd):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "SHARD", 5)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(rng.randint(1, 4)):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = {f: f - (1 << 64) * (f >> 63) for f in fps}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))
    got = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    want = components(signed.values(), [(signed[a], signed[b]) for a in fps for b in fps if (a ^ b).bit_count() <= 4])
    assert {f: got.get(f, f) for f in signed.values()} == want


def test_routes_leave_no_pair_out():
    for n in (10, 10**8, 10**10, 10**12):
        ways = simhash.routes(n)
        assert {b for way in ways for b in way} == set(range(64))
        rng = random.Random(n)
        for _ in range(200):
            gone = set(rng.sample(range(64), 4))
            assert any(not gone & set(way) for way in ways)


def test_bands_grow_with_the_corpus():
    for n in (10, 10**6, 10**9):
        chosen = simhash.bands(n)
        assert n >> len(chosen[0]) <= simhash.BAND_AIM and (not chosen[0] or (1 - (5 / 6) ** len(chosen[0])) ** len(chosen) <= simhash.MISSED)


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_similar_texts_share_a_group(spark, docs):
    rng = random.Random(3)
    rows = []
    for f in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        for c in range(6):
            w = list(words)
            for i in rng.sample(range(300), c * 4):
                w[i] = f"n{rng.randint(0, 10**6)}"
            rows.append((f * 10 + c, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a[0], b[0], jaccard(a[1], b[1])) for k, a in enumerate(rows) for b in rows[:k] if a[0] // 10 == b[0] // 10]
    near = [(a, b) for a, b, j in pairs if j >= 0.85]
    assert sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    assert all(a // 10 == c // 10 for a, c in got.items())
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (3, 5)").count() == 1
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and simhash.deduplicated(docs.where("false")).count() == 0


def test_repeated_lines_do_not_part_equal_sets(spark):
    rng = random.Random(5)
    line = " ".join(f"b{i}" for i in range(12))
    rows = []
    for f in range(60):
        text = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
        rows += [(2 * f, f"{text} {line} {line}"), (2 * f + 1, " ".join([text] + [line] * (10, 20, 40)[f % 3]))]
    assert all(jaccard(rows[k][1], rows[k + 1][1]) == 1 for k in range(0, 120, 2))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * f + 1] == got[2 * f] for f in range(60))


@pytest.mark.parametrize("part", [32 << 20, 9000])
def test_groups_are_decided_exactly(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_BYTES", part)
    rng = random.Random(7)
    rows, links = [], []
    for f in range(160):
        words = [f"w{rng.randint(0, 9000)}" for _ in range(600)]
        rows.append((10 * f, " ".join(words)))
        for c in range(1, 3):
            w = list(words)
            for i in rng.sample(range(0, 600, 5), 12 + 2 * (f % 3) + c):
                w[i] = f"n{rng.randint(0, 10**6)}"
            rows.append((10 * f + c, " ".join(w)))
        of = rows[-3:]
        links += [(a[0], b[0], jaccard(a[1], b[1])) for k, a in enumerate(of) for b in of[:k]]
    assert sum(0.8 <= j <= 0.82 for _, _, j in links) > 20 and sum(0.74 <= j < 0.8 for _, _, j in links) > 20
    want = components([i for i, _ in rows], [(a, b) for a, b, j in links if j >= 0.8])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    apart, joined = (sum(k) for k in zip(*((want[a] == want[b] and got[a] != got[b], want[a] != want[b] and got[a] == got[b]) for a, b, _ in links)))
    assert joined == 0 and apart <= 0.02 * len(links)


def test_rows_without_a_copy_stay_whatever_their_id(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 9000)}" for _ in range(60)) for _ in range(12)]
    ids = [None] * 5 + [7] * 4 + [1, 2, 3]
    rows = [(i, t, f"row{k}") for k, (i, t) in enumerate(zip(ids, texts))] + [(None, texts[9], "copy"), (0, texts[10], "least"), (7, texts[5], "copy"), (None, texts[0], "copy")]
    for row in ("_row", "other"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {row} string")
        got = simhash.deduplicated(df)
        assert got.columns == df.columns
        kept = got.collect()
        assert sorted(r["text"] for r in kept) == sorted(texts)
        assert {r["text"]: r["doc_id"] for r in kept} == {t: 0 if k == 10 else i for k, (i, t) in enumerate(zip(ids, texts))}


def test_components_of_a_path_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUSY", 10)
    monkeypatch.setattr(graph, "BUSY_NODES", 10)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}


# Sharding -----------------------------------------------------------------------------------------------------------


def sharded(rows, n, law):
    """(id, size, crc, shard, slot) of each row, from the whole order in memory."""
    digits = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)
    data = sorted(((digits((t or "").encode()), digits(b"" if i is None else str(i).encode()), k) for k, (i, t) in enumerate(rows)))
    size = [len((t or "").encode()) + 1 for _, t in rows]
    total, groups, at, out, slots = sum(size), defaultdict(list), 0, [], Counter()
    for key, _, k in data:
        groups[key].append((at, size[k]))
        at += size[k]
    at = 0
    for nth, (key, _, k) in enumerate(data):
        whole = sum(s for _, s in groups[key])
        middle = groups[key][0][0] + whole / 2 if whole <= max(1, 0.005 * total / n) else at + size[k] / 2
        at += size[k]
        shard = min(n - 1, int(middle * n / total)) if law == "bytes" else nth * n // len(rows)
        out.append((rows[k][0], size[k], zlib.crc32((rows[k][1] or "").encode()), shard, slots[shard]))
        slots[shard] += 1
    return out


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_shards(docs, law):
    got = sharding.assign_shards(docs, 4, law, n_ranges=3).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    if law == "key":
        assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
        again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.limit(20), 4, law).collect()}
        assert all(again.get(r["doc_id"], r["shard"]) == r["shard"] for r in got)
    else:
        assert all(r["grown_shard"] is None for r in got)
        assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got))) == sorted(map(str, sharded(ROWS, 4, law)))


@pytest.mark.parametrize("ids", ["id", "null"])
def test_a_hot_text_is_divided(spark, ids):
    rows = [(i if ids == "id" else None, "" if i % 3 == 0 else "the same text " * 5 if i % 3 == 1 else f"own {i // 5} " + "text " * 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for law in ("bytes", "rows"):
        got = sharding.assign_shards(df, 8, law, n_ranges=32).collect()
        assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got))) == sorted(map(str, sharded(rows, 8, law)))
    sizes = Counter()
    for r in sharding.assign_shards(df, 8).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values())
    assert sharding.assign_shards(df.where("false"), 8).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df, 8, "other")


def test_no_range_is_overfull(spark):
    rows = [(i, "") for i in range(2000)] + [(i, f"text {i} " * 40) for i in range(2000, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("length(text) + 1 AS size", "cast(conv(substr(md5(text), 1, 15), 16, 10) AS long) AS key", "doc_id AS tie", "doc_id AS rid").cache()
    n, total = 3000, df.agg(F.sum("size")).first()[0]
    bounds = sharding.boundaries(df, n, total, 20)
    got = df.withColumn("range", sharding._range_of(bounds)("key", "tie", "rid")).collect()
    assert max(Counter(r["range"] for r in got).values()) <= 4 * n / 20
    assert all(sum((r["key"], r["tie"], r["rid"]) >= b for b in bounds) == r["range"] for r in got)


# Mixing -------------------------------------------------------------------------------------------------------------


def test_mix_stays_within_a_block_of_the_weights(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = mixing.mix(rows, block_rows=8, period=100).select("source", "slot", "doc_id", "epoch").distinct().collect()
    plan = {r["source"]: r for r in mixing.plan(rows.groupBy("source").agg(F.count("*").alias("n")), period=100, block_rows=8).collect()}
    served = {}
    for r in got:
        assert served.setdefault(r["slot"], r["source"]) == r["source"]
    total = next(iter(plan.values()))["total"]
    assert sorted(served) == list(range(total)) and sum(p["units"] for p in plan.values()) == 100
    seen = Counter()
    for t in range(total):
        seen[served[t]] += 1
        for s, p in plan.items():
            assert abs(seen[s] - (t + 1) * p["units"] / 100) < 1
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == set(range(4000))


def test_mix_of_awkward_rows(docs):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter(map(str, docs.collect())).keys() == Counter(map(str, got.collect())).keys()
    assert mixing.mix(docs.where("false")).count() == 0
    given = mixing.mix(docs, weights={"a": 3.0, "b": 1.0}, period=10, block_rows=1).groupBy("source").count()
    counts = {r["source"]: r["count"] for r in given.collect()}
    assert counts["a"] > 2 * counts["b"] and set(counts) == {"", "a", "b"}


# Quality ------------------------------------------------------------------------------------------------------------


def _corpus(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = i % 4 > 0
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 8 else " | ".join(words[:5] * 9)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _corpus(spark)
    rules = quality.train(docs, labels)
    assert 0 < len(rules.terms) < 100
    got = quality.scored(docs, rules).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, flipped) == rules  # held-out labels teach nothing
    left = quality.kept(docs, rules)
    assert left.columns == docs.columns and 430 <= left.count() <= 470


def statistics(t):
    t = t or ""
    import regex

    n, words, lines = max(len(t), 1), regex.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
    words, lines = [w for w in words if w], [x for x in lines if x]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    count = lambda p: len(regex.findall(p, t))
    return {
        "upper": count(r"\p{Lu}") / n, "digit": count(r"\p{Nd}") / n, "sign": count(r"[^\p{L}\p{Nd} \t\n\x0b\f\r.,]") / n, "stop": count(r"[.,]") / n, "word_length": len(t) / nw, "log_words": np.log1p(len(words)),
        "distinct_words": len(set(words)) / nw, "distinct_lines": len(set(lines)) / nl, "line_length": np.log1p(n / nl), "signed_words": count(r"[^\p{L}\p{Nd} \t\n\x0b\f\r.,](?:[ \t\n\x0b\f\r]|$)") / nw,
    }


def test_scores_equal_plain_python(spark, docs):
    corpus, labels = _corpus(spark)
    rules = quality.train(corpus, labels)
    for rows, df in (([(r["doc_id"], r["text"]) for r in corpus.collect()], corpus), (ROWS, docs)):
        want = []
        for i, t in rows:
            s = statistics(t)
            z = rules.bias + sum(w for w, conditions in rules.terms if all((s[name[3:]] > cut) == above for name, above, cut in conditions))
            p = 1 / (1 + np.exp(-z))
            want.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(p, 9), int(p >= 0.5)))
        got = [(str(r["doc_id"]), r["held_out"], round(r["score"], 9), r["predicted"]) for r in quality.scored(df, rules).collect()]
        assert sorted(got) == sorted(want)
    more = docs.selectExpr("*", "1 AS _n", "2 AS _t", "3 AS _words", "4 AS _lines", "5 AS _nw", "6 AS _nl", "7 AS _text", "8 AS _s_upper", "9 AS _row")
    left = quality.kept(more, rules)
    assert left.columns == more.columns and left.count() == sum(w[-1] for w in want)


def test_scores_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id long, quality int")
    for some in (labels, labels.where("false")):
        got = quality.scored(docs, quality.train(docs, some)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    rules = quality.train(*_corpus(spark))
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, rules).collect())
    assert quality.scored(docs.where("false"), rules).count() == 0


# Licences -----------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = licences.RULES["mit-text"][1]
    wrapped = "\n".join("# " + x for x in re.findall(r".{1,60}(?:\s|$)", " ".join(mit)))
    bsd3 = licences.RULES["bsd-3-text"][1]
    rows = [
        (1, "Some prose.\nReleased under the MIT License."), (2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"), (3, wrapped), (4, "\n".join(bsd3)), (5, "\n".join(reversed(bsd3))),
        (6, " ".join([bsd3[0], "One. Two. Three. Four.", *bsd3[1:]])), (7, "// SPDX-License-Identifier: MPL-2.0\n"), (8, None), (9, ""), (None, "Licensed under CC BY-NC 4.0."), (10, "the MIT License is released"),
    ]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rules string")).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "MIT", 4: "BSD-3-Clause", 5: "", 6: "", 7: "MPL-2.0", 8: "", 9: "", None: "CC-BY-NC-4.0", 10: ""}


def plain_scan(text):
    """Rules found by walking each text's sentences, without patterns over codes."""
    clean = re.sub(r"[^A-Za-z0-9\n.;:!?]+", " ", re.sub(r"(?m)^[ \t]*(//+|#+|\*+|--+|/\*+|<!--)[ \t]*", "", text or "")).lower()
    joined = re.sub(" +", " ", re.sub(r"\n *\n[ \n]*", "! ", clean).replace("\n", " "))
    found = set()
    for cut in (re.split(r"[.;:!?]+(?: |\n|$)|\n", clean), re.split(r"[.;:!?]+(?: |$)", joined)):
        units = [s.strip(" ") for s in cut if s.strip(" ")]
        units = [re.sub("^neither the name of .* nor the names of (its|their) contributors may", "neither the name of the copyright holder nor the names of its contributors may", s) for s in units]
        known = {x for _, lines in licences.RULES.values() for line in lines for x in licences.sentences(line)}
        for name, (_, lines) in licences.RULES.items():
            want = [x for line in lines for x in licences.sentences(line)]
            at = {i for i, u in enumerate(units) if u == want[0]}
            for x in want[1:]:
                at = {j for i in at for j in range(i + 1, min(len(units), i + 4)) if units[j] == x and not any(u in known for u in units[i + 1 : j])}
            if at:
                found.add(name)
    return sorted(found)


def test_rules_equal_a_plain_walk(spark):
    rng = random.Random(12)
    every = [line for _, lines in licences.RULES.values() for line in lines] + ["Neither the name of the Bird Society nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
    rows = []
    for i, (_, lines) in enumerate(licences.RULES.values()):
        rows += [(3 * i, "Intro.\n" + "\n".join(lines)), (3 * i + 1, "/* " + " ".join(f"{x} Other words." for x in lines)), (3 * i + 2, "# " + "\n# ".join(re.findall(r".{1,50}(?:\s|$)", " ".join(lines))))]
    for i in range(300):
        rows.append((1000 + i, rng.choice(["\n", " "]).join(rng.choice([*every, "Some prose.", "Numbers 12 and 34!", "x"]) for _ in range(rng.randint(0, 9)))))
    bsd = licences.RULES["bsd-3-text"][1]
    rows.append((5000, "\n".join([*bsd[:3], every[-1], bsd[4]])))
    got = {r["doc_id"]: r["rules"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ",".join(plain_scan(t)) for i, t in rows}
    assert got[5000] == "bsd-3-text" and {x for r in got.values() for x in r.split(",")} >= set(licences.RULES)


def test_licence_scan_of_awkward_rows(docs):
    assert licences.scan(docs).count() == len(ROWS)
    assert licences.scan(docs.where("false")).count() == 0
