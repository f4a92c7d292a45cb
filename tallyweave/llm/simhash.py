"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprint: XXH64 (seed 42) of each k-word shingle, repeats included; a bit
is set where over half of the hashes set it.  Texts are lower-cased in A-Z and
cut at ASCII white space.

Fingerprints that differ in at most ``max_bits`` bits link.  Distinct
fingerprints are cut into ``max_bits + 1`` blocks of bits (more for larger
inputs, see ``routes``), so that linked ones agree on one block at least, and
meet there.  Where they meet, fingerprints are sorted by Gray rank, which sets
neighbours with few differing bits together; runs of them form nodes that keep
the bits on which all members agree.  A pair of nodes whose agreed bits differ
in more than ``max_bits`` places is dropped with all its members; what is left
is followed down to single fingerprints.  A group too large for one task meets
again on blocks of the bits that its members need not share, by the same rule;
what is too large even then is split in parts and each pair of parts meets
once, so nothing is capped.  A task returns a spanning forest of what it links.

Null texts have no words, like empty ones: fingerprint zero, which links like
any other.  Null ids get a component too (the least id that is not null, if
any).  Repeated rows are separate rows.  An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, beside, dropped, free_name, frugal, release_shuffles, table, written
from .graph import connected_components, local_components

WORDS, MAX_BITS, SEED = 4, 4, 42
FANOUT = 8
#: Node pairs followed at once; fingerprints of a group that one task takes; of a group that meets again on other blocks.
FRONTIER, PART, CROWD = 1 << 19, 1024, 16_384
#: Fingerprints aimed at for a group when choosing blocks.
GROUP_AIM = 8192
#: Rows of whole groups that a similarity search takes at once.
SHARD = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) < words:
        return xxh64_intdigest(norm, seed)
    begin, end = [0, *(gaps[: len(gaps) - words + 2] + 1).tolist()], [*gaps[words - 1 :].tolist(), len(norm)]
    counts, n = np.zeros(64, np.int64), len(end)
    for i in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(norm[a:b], seed) for a, b in zip(begin[i : i + (1 << 16)], end[i : i + (1 << 16)], strict=False)], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a bigint)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def each(batches):
        for b in batches:
            texts = pc.fill_null(b.column(1), "").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(frugal(each), f"doc_id {id_type}, fp long")


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` cut in ``n`` runs of about equal length."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def routes(n: int, max_bits: int = MAX_BITS) -> list[list[int]]:
    """The bits to meet on, way by way.  With max_bits + 1 + c blocks, linked
    fingerprints agree on c + 1 of them."""
    c = 0
    while c < 3 and n >> (64 * (c + 1) // (max_bits + 1 + c)) > GROUP_AIM:
        c += 1
    cut = blocks(list(range(64)), max_bits + 1 + c)
    return [sum(chosen, []) for chosen in combinations(cut, c + 1)]


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint, as a number."""
    out = np.zeros(len(fp), np.uint64)
    for bit in bits:
        out = out << np.uint64(1) | (fp >> np.uint64(bit) & np.uint64(1))
    return out.view(np.int64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A forest over fingerprints grouped by key; one root for each key."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), keys))
        keys = keys[self.order]
        pattern, mask = fps[self.order], np.full(len(fps), ~np.uint64(0))
        self.levels = [(pattern, mask)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while len(keys) and (keys[1:] == keys[:-1]).any():
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(first, len(keys)))
            within = np.arange(len(keys)) - np.repeat(first, sizes)
            heads = np.flatnonzero(within % FANOUT == 0)
            every, some = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
            mask = np.bitwise_and.reduceat(mask, heads) & ~(every ^ some)
            pattern = every & mask
            self.children.append((heads, np.diff(np.append(heads, len(keys)))))
            self.levels.append((pattern, mask))
            keys = keys[heads]

    def links(self, max_bits: int):
        """Arrays (i, j) of rows, i <> j, of the same key within ``max_bits``."""
        n = len(self.levels[-1][0])
        todo = [(len(self.levels) - 1, np.arange(n), np.arange(n))]
        while todo:
            level, a, b = todo.pop()
            most = max(1, FRONTIER // FANOUT**2) if level else FRONTIER  # a pair of nodes has so many pairs of children
            if len(a) > most:
                todo += [(level, a[i : i + most], b[i : i + most]) for i in range(0, len(a), most)]
                continue
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            first, size = self.children[level - 1]
            reps = size[a] * size[b]
            at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            a, b = np.repeat(a, reps), np.repeat(b, reps)
            x, y = first[a] + at // size[b], first[b] + at % size[b]
            keep = (x < y) | ((x == y) & (level > 1))
            x, y = x[keep], y[keep]
            pattern, mask = self.levels[level - 1]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= max_bits
            if near.any():
                todo.append((level - 1, x[near], y[near]))


def _parted(met: DataFrame, codes: DataFrame, group: list[str], node: str, carry: list[str]) -> DataFrame:
    """``met`` with ``key``, one for each group of at most PART rows; larger
    groups are split in parts, with a key for each two of them.  ``codes``:
    the groups of the same rows alone."""
    sizes = codes.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > PART)
    parts = beside(written(sizes.select(*group, F.ceil(F.col("n") / PART).cast("int").alias("parts")), "parts"))
    met = met.join(parts, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64(node), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(F.xxhash64(*group, F.least("part", "other"), F.greatest("part", "other")).alias("key"), *carry)


def _shards(batches, most: int):
    """The columns of whole keys (the first column, ascending), several at a time up to about ``most`` rows."""
    held, size = [], 0
    for b in batches:
        keys = b.column(0).to_numpy()
        if size > most and len(keys):  # a key is never parted
            same = int(np.argmax(np.append(keys != held[-1][0][-1], True)))
            if same:
                held.append(tuple(c.slice(0, same).to_numpy(zero_copy_only=False) for c in b.columns))
            if same < len(keys):
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
            b = b.slice(same)
        if b.num_rows:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            size += b.num_rows
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links within
    ``max_bits`` do.  ``fps``: distinct fingerprints, column fp."""
    ways = routes(fps.count(), max_bits)
    # Where linked fingerprints agree on a way's bits, they differ in at most max_bits of the others.
    again = [blocks([b for b in range(64) if b not in way], max_bits + 1) for way in ways]

    def meet(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i, way in enumerate(ways):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(values(fp, way)), b.column(0)], ["way", "value", "fp"])

    def meet_again(batches):
        for b in batches:
            way, fp = b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            for w in np.unique(way).tolist():
                own = way == w
                for k, bits in enumerate(again[w]):
                    yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (np.full(len(fp), w * len(again[w]) + k + len(ways), np.int32), b.column(1).to_numpy() * 31 + values(fp, bits) * 0x9E3779B1 + 7, b.column(2).to_numpy())], ["way", "value", "fp"])

    met = fps.select("fp").mapInArrow(meet, "way int, value long, fp long")
    # Crowds: at most a CROWD-th of all meetings.
    crowds = beside(written(met.groupBy("way", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("way", "value"), "crowds"))
    met = met.join(crowds, ["way", "value"], "left_anti").unionByName(met.join(crowds, ["way", "value"], "left_semi").select("way", "value", "fp").mapInArrow(meet_again, "way int, value long, fp long"))
    met = _parted(met, met, ["way", "value"], "fp", ["fp"])

    def join(batches):
        for keys, fp in _shards(batches, SHARD):
            labels = np.arange(len(fp))
            for i, j in GrayIndex(keys, fp.view(np.uint64)).links(max_bits):
                labels = local_components(len(fp), i, j, labels)
            linked = np.flatnonzero(labels != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[labels[linked]])], ["a", "b"])

    return met.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(join), "a long, b long").where("a <> b")


def near_duplicates(df: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(df, words, id_col, text_col), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    groups = connected_components(links(distinct.select("fp"), max_bits))
    label = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = label.groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(label.select("fp", "label").join(least, "label"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similarity search: texts aimed at for a value of a band, chance that a pair of similarity 0.8 meets in none,
#: most differing bits of a pair looked at (3.6 standard deviations beyond those of such a pair), bins of a profile.
BAND_AIM, MISSED, FAR_BITS, BINS = 256, 0.003, 21, 64
#: Bytes of shingle sets in a part of a group of candidates; pairs whose profiles are compared at once.
PART_BYTES, ROWS_AT_ONCE = 32 << 20, 1 << 14


def bands(n: int) -> list[list[int]]:
    """Random choices of bits to meet on: with more texts more bits, so that a
    value's texts stay few, and as many more choices as a pair needs that
    differs in one bit of six (similarity 0.8)."""
    bits = math.ceil(math.log2(max(1, n / BAND_AIM)))
    if not bits:
        return [[]]
    rng = np.random.default_rng(SEED)
    return [rng.choice(64, bits, replace=False).tolist() for _ in range(math.ceil(math.log(MISSED) / math.log1p(-((5 / 6) ** bits))))]


def shingle_set(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The sorted hashes of the text's shingles, each once."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    return np.unique(np.array([xxh64_intdigest(b" ".join(w[i : i + words]), seed) for i in range(max(1, len(w) - words + 1))] if w else [], np.uint64))


def profiled(h: np.ndarray) -> tuple[int, bytes]:
    """The fingerprint of a set of shingles (repeats count once, as in its
    similarity), and a profile of the set: in each of BINS ranges of hashes
    four bits of the least one."""
    if not len(h):
        return 0, bytes(BINS // 2)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    profile = np.zeros(BINS, np.uint8)
    profile[bins[first]] = h[first] % np.uint64(15) + np.uint64(1)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big"), (profile[::2] << 4 | profile[1::2]).tobytes()


def opened(profiles) -> np.ndarray:
    """Profiles as a matrix, a column for each bin (0: no hash)."""
    packed = np.frombuffer(b"".join(profiles), np.uint8).reshape(-1, BINS // 2)
    return np.stack((packed >> 4, packed & 15), axis=2).reshape(-1, BINS)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of profiles, row by row (a little above it: one in 15 unlike bins agrees by chance)."""
    some = (a | b) != 0
    return ((a == b) & some).sum(1) / np.maximum(some.sum(1), 1)


def loose(least: float) -> float:
    """An estimate that a pair of similarity ``least`` misses by chance alone hardly ever: four standard errors below."""
    return max(0.0, least - 4 * (least * (1 - least) / BINS) ** 0.5)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return float(not len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int(np.count_nonzero(b[at] == a))
    return common / (len(a) + len(b) - common)


def exact_labels(sets: list[np.ndarray], profile: np.ndarray, part: np.ndarray, across: bool, least: float) -> np.ndarray:
    """Labels that the pairs of similarity ``least`` or more join, each pair
    joined by the sets themselves.  Pairs that are joined already are passed
    over.  ``across``: only pairs of different parts."""
    n = len(sets)
    labels, sizes, enough = np.arange(n), np.array([len(x) for x in sets]), loose(least)
    for i in range(n - 1):
        far = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
        if across:
            far = far[part[far] != part[i]]
        small, large = np.minimum(sizes[far], sizes[i]), np.maximum(sizes[far], sizes[i])
        far = far[small >= least * large * (1 - 1e-9)]  # no other sizes can be as similar
        for s in range(0, len(far), ROWS_AT_ONCE):
            some = far[s : s + ROWS_AT_ONCE]
            estimate = similarity(profile[i][None], profile[some])
            likely = np.flatnonzero(estimate >= enough)
            for j in some[likely[np.argsort(-estimate[likely], kind="stable")]].tolist():
                if labels[i] != labels[j] and jaccard(sets[i], sets[j]) >= least:
                    x, y = sorted((labels[i], labels[j]))
                    labels[labels == y] = x
    return labels


def _verified(candidates: DataFrame, least: float) -> DataFrame:
    """(a, b): links between nodes of one group of candidates that their sets
    of shingles bear out.  ``candidates``: component, node, profile, shingles."""
    sizes = candidates.groupBy("component").agg(F.sum(F.length("shingles").cast("long") + BINS).alias("n")).where(F.col("n") > PART_BYTES)
    parts = sizes.select("component", F.ceil(F.col("n") / PART_BYTES).cast("int").alias("parts"))
    met = candidates.join(parts, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("component", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "profile", "shingles")

    def join(batches):
        held: list[tuple] = []
        held_key = None

        def done():
            if len(held) > 1:
                node = np.array([x[1] for x in held])
                profile = opened(x[2] for x in held)
                labels = exact_labels([np.frombuffer(x[3], np.uint64) for x in held], profile, np.array([x[0] for x in held]), held_key[1] != held_key[2], least)
                linked = np.flatnonzero(labels != np.arange(len(held)))
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], ["a", "b"])

        for b in batches:
            columns = [b.column(i) for i in range(7)]
            for key, row in zip(zip(*(c.to_pylist() for c in columns[:3]), strict=True), zip(*(c.to_pylist() for c in columns[3:]), strict=True), strict=True):
                if key != held_key:
                    yield from done()
                    held, held_key = [], key
                held.append(row)
        yield from done()

    return met.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").mapInArrow(frugal(join), "a long, b long")


def similar(df: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: groups of texts that links of Jaccard similarity
    ``least`` or more between their sets of shingles join."""
    rows = written(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_row")), "rows")
    labels = _labelled(rows, words, least)
    least_id = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labels.join(least_id, "label").select("doc_id", "component_id")


def _labelled(rows: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, _row, label: rows of one group have one label.  ``rows``: a
    written table with doc_id, text and _row, a key of the row.

    Similar texts differ in more bits than blocks can hold apart, so
    fingerprints meet on random choices of bits (``bands``); pairs within
    FAR_BITS that the Gray-order index finds there are candidates if profiles
    of their shingles do not rule them out.
    Candidates form groups; within each, pairs are decided by their whole sets."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def each(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            texts = pc.fill_null(b.column(2), "").cast(pa.binary())
            got = [(*profiled(h), xxh64_intdigest(h.tobytes(), SEED)) for h in (shingle_set(t.as_py(), words) for t in texts)]
            fps, node = (pa.array(np.array([g[k] for g in got], np.uint64).view(np.int64)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, pa.array([g[1] for g in got], pa.binary()), node], ["doc_id", "_row", "fp", "profile", "node"])

    with batch_rows(rows.sparkSession, 1000):
        docs = written(rows.select("doc_id", "_row", "text").mapInArrow(frugal(each), f"doc_id {id_type}, _row long, fp long, profile binary, node long"), "profiles")
    nodes = docs.groupBy("node").agg(F.first("fp").alias("fp"), F.first("profile").alias("profile"), F.min("_row").alias("_row"))
    chosen = bands(nodes.count())

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for i, bits in enumerate(chosen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(values(fp, bits)), *b.columns], ["band", "value", *b.schema.names])

    met = nodes.select("fp", "node", "profile").mapInArrow(spread, "band int, value long, fp long, node long, profile binary")
    codes = nodes.select("fp").mapInArrow(spread, "band int, value long, fp long")
    met = _parted(met, codes, ["band", "value"], "node", ["node", "fp", "profile"])
    enough = loose(least)

    def join(batches):
        for keys, node, fp, profile in _shards(batches, SHARD):
            profile = opened(profile)
            labels = np.arange(len(fp))
            for i, j in GrayIndex(keys, fp.view(np.uint64)).links(FAR_BITS):
                for s in range(0, len(i), 1 << 14):
                    a, b = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
                    apart = labels[a] != labels[b]
                    a, b = a[apart], b[apart]
                    near = similarity(profile[a], profile[b]) >= enough
                    labels = local_components(len(fp), a[near], b[near], labels)
            linked = np.flatnonzero(labels != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], ["a", "b"])

    edges = met.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(join), "a long, b long")
    groups = connected_components(edges)
    spark = rows.sparkSession
    release_shuffles(spark)

    def sets(batches):
        for b in batches:
            texts = pc.fill_null(b.column(3), "").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingle_set(t.as_py(), words).tobytes() for t in texts], pa.binary())], ["component", "node", "profile", "shingles"])

    # A node stands for one set of shingles; its first row has the text.
    with batch_rows(spark, 1000):
        asked = beside(written(nodes.join(groups, "node").select("component", "node", "profile", "_row"), "asked"))
        texts = rows.join(asked, "_row").select("component", "node", "profile", "text")
        candidates = written(texts.mapInArrow(frugal(sets), "component long, node long, profile binary, shingles binary"), "candidates")
        links = written(_verified(candidates, least), "verified")
    dropped(candidates)
    groups = connected_components(links)
    return docs.join(groups, "node", "left").select("doc_id", "_row", F.coalesce("component", "node").alias("label"))


def deduplicated(df: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group that ``similar`` finds, with the columns of
    ``df``: a row of the group's least id, null ids last.  Rows of different
    groups stay each, also where they repeat an id or have none."""
    key = free_name("_row", df)
    rows = written(df.withColumn(key, F.monotonically_increasing_id()), "rows")
    labels = _labelled(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(key).alias("_row")), words, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    several = labels.groupBy("label").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("label", F.col("first._row").alias("first"))
    gone = labels.join(several, "label").where("_row <> first").select(F.col("_row").alias(key))
    return rows.join(beside(written(gone, "gone")), key, "left_anti").select(*df.columns)


def op7_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
