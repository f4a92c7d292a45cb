"""Removal of repeated byte strings, by suffix arrays over shards.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Strings are those of the input, overlaps count.

1. Anchors.  In each window of ``length`` bytes the anchor is the ``GRAM``-byte
   gram with the least hash, so equal windows have equal anchors at the same
   place.  An anchor's context is the bytes that windows with it can reach.
   Anchors travel as packed arrays of (gram hash, context hash, id, place),
   about 16 bytes for each 14 bytes of text; copies within a batch of rows
   send one document's only.
2. Anchors of one gram meet.  Where contexts are equal, all but the least
   document's go whole.  Where one gram has several contexts, each context's
   least document sends the context's bytes on, once.
3. Those bytes are dealt into shards by gram; every shard sorts its suffixes by
   external induced sorting (``induced.py``), which carries common prefixes
   along.  Runs of suffixes that share ``length`` bytes are equal windows; all
   but those of the run's least document go.
4. Each document's spans are united and cut out.

A gram in very many contexts is divided by the bytes beside it: a window
reaches past its gram by half the rest on one side at least.

Texts beyond a block are hashed and sent block by block.  Null texts are empty.
A null id ranks with the greatest bigint, after all others, and never has a
smaller document among null ids; rows that repeat an id are documents of equal
rank, none smaller than the other, and are cut each.  Texts below ``length``
bytes stay whole.  An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, frugal, planes, release_shuffles, table, unplanes, written
from .induced import suffix_order

LENGTH, GRAM = 50, 24
#: Bytes of text hashed at once; of text whose anchors are packed together; of contexts in a shard; contexts
#: of a gram beyond which it is divided; contexts sent in a batch; rows handed to Python at once.
BLOCK, PACKED, SHARD, MANY, SENT, ROWS = 1 << 19, 4 << 20, 1 << 19, 10_000, 8192, 1000
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Powers:
    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.full(n + n // 4, _BASE, np.uint64))
                cls.down = np.cumprod(np.full(n + n // 4, pow(_BASE, -1, 1 << 64), np.uint64))
        return cls.up, cls.down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """f over x[i : i + w] for each i; short at the end."""
    done, width = x, 1
    while width < w:
        step = min(width, w - width)
        done = np.append(f(done[:-step], done[step:]), done[-step:]) if len(done) > step else done
        width += step
    return done


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, starts: slice | None = None):
    """(gram hash, context hash, text, place in it) of the anchors of ``texts``;
    ``starts``: of windows that start there only."""
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, w = len(data), length - gram + 1
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if n < length:
        return none
    with np.errstate(over="ignore"):
        up, down = _Powers.of(n + 1)
        v = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(29)
        v *= up[:n]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v)))
        h = _mix((total[gram:] - total[:-gram]) * down[: n - gram + 1]) | np.uint64(1)
        least = _sliding(np.minimum, h, w)[: n - length + 1]
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):  # windows that leave their text
            least[max(a, b - length + 1) : b] = 0
        if starts:
            least[: starts.start] = 0
            least[starts.stop :] = 0
        # The greatest of the least over the windows that hold a gram: its own hash if it is the anchor of one.
        padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
        at = np.flatnonzero(_sliding(np.maximum, padded, w)[: len(h)] == h)
        text = np.searchsorted(firsts, at, "right") - 1
        low, high = np.maximum(at - (w - 1), firsts[text]), np.minimum(at + length, firsts[text + 1])
        context = _mix((total[high] - total[low]) * down[low]) + ((at - low) * 64 + (high - at)).astype(np.uint64) * _MIX
    return h[at], context, text, at - firsts[text]


def long_anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, most: int = BLOCK):
    """(gram hash, context hash, place) of one text's anchors, the windows of
    ``most`` bytes at a time; an anchor of windows of two blocks comes with both."""
    w, windows = length - gram + 1, len(text) - length + 1
    for s in range(0, windows, most):
        e = min(s + most, windows)
        low = max(0, s - w + 1)
        h, c, _, at = anchors([text[low : e + w - 2 + length]], length, gram, slice(s - low, e - low))
        yield h, c, at + low


def _blocks(column: pa.Array, most: int):
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if size and size + s > most:
            yield at, i
            at, size = i, 0
        size += s
    if at < len(sizes):
        yield at, len(sizes)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _send(buckets: int, length: int, gram: int):
    """Anchors by bucket, packed; those whose context stands in the batch with a smaller id go to spans at once (bucket -1)."""

    def packs(batches):
        for b in batches:
            for s, e in _blocks(b.column(2), PACKED):
                yield b.slice(s, e - s)

    def found(column):
        for s, e in _blocks(column, BLOCK):
            texts = _bytes(column.slice(s, e - s))
            longest = max(range(len(texts)), key=lambda i: len(texts[i]))
            if len(texts[longest]) > BLOCK:  # those beside it are empty
                for h, c, at in long_anchors(texts[longest], length, gram, BLOCK):
                    yield h, c, np.full(len(at), s + longest), at
            else:
                h, c, text, at = anchors(texts, length, gram)
                yield h, c, text + s, at

    def together(column):
        held, size = [], 0
        for part in found(column):
            held.append(part)
            size += len(part[0])
            if size > PACKED // 8:  # more than a pack of ordinary texts has
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def send(batches):
        for b, (h, c, row, at) in ((b, part) for b in packs(batches) for part in together(b.column(2))):
            keys, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((at, keys[row], ids[row], c, h))
            h, c, row, at = h[order], c[order], row[order], at[order]
            head = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            least = ids[row][np.flatnonzero(head)][np.cumsum(head) - 1]
            gone = ids[row] > least
            if gone.any():
                r, a = row[gone], at[gone]
                o = np.lexsort((a, r))
                yield from _spans(keys[r[o]], a[o])
            h, c, row, at = h[~gone], c[~gone], row[~gone], at[~gone]
            bucket = (h >> np.uint64(32)).astype(np.int64) * buckets >> 32
            order = np.lexsort((at, keys[row], ids[row], bucket))
            h, c, row, at, bucket = h[order], c[order], row[order], at[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out = []
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
                i, k = ids[row[s:e]], keys[row[s:e]]
                same = bool((i == k).all())
                steps = np.diff(i, prepend=i[:1]).view(np.uint64)
                wide = 4 if steps.max() < 1 << 32 and at[s:e].max() < 1 << 32 else 8
                blob = (planes(h[s:e], 6) + planes(c[s:e], 8) + planes(steps, wide) + planes(at[s:e].view(np.uint64), wide) + (b"" if same else k.tobytes()))
                out.append((int(bucket[s]), e - s, wide, same, int(i[0]), blob))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], _SENT)

    return send


_SENT = ["bucket", "n", "wide", "same", "first", "blob"]
_SENT_SCHEMA = "bucket int, n int, wide int, same boolean, first long, blob binary"


def _spans(keys: np.ndarray, at: np.ndarray):
    """Rows that carry spans of one document each, as packed places."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = [*cuts[1:].tolist(), len(keys)]
    blobs = [at[s:e].tobytes() for s, e in zip(cuts.tolist(), ends, strict=True)]
    n = len(cuts)
    arrays = [pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool)), pa.array(keys[cuts]), pa.array(blobs, pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, _SENT)


def _unpack(n: int, wide: int, same: bool, first: int, blob: bytes):
    cut = np.cumsum([0, 6 * n, 8 * n, wide * n, wide * n])
    h, c, steps, at = (unplanes(blob[a:b], w) for a, b, w in zip(cut[:-1], cut[1:], (6, 8, wide, wide), strict=True))
    ids = first + np.cumsum(steps.view(np.int64))
    return h, c, ids, ids if same else np.frombuffer(blob[cut[-1] :], np.int64), at.view(np.int64)


def _meet(batches):
    """(kind, key, id, gram, places): kind 0, contexts of ``key`` to cut at ``places``;
    kind 1 (2 for a gram of many contexts), a context whose bytes are needed."""
    held, now = [], None

    def done():
        if not held:
            return
        h, c, ids, keys, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        head = np.append(True, h[order][1:] != h[order][:-1])
        size = np.diff(np.append(np.flatnonzero(head), len(h)))
        order = order[np.repeat(size > 1, size)]
        if not len(order):
            return
        h, c, ids, keys, at = (x[order] for x in (h, c, ids, keys, at))
        order = np.lexsort((at, keys, ids, c, h))
        h, c, ids, keys, at = (x[order] for x in (h, c, ids, keys, at))
        gram = np.append(True, h[1:] != h[:-1])
        head = gram | np.append(True, c[1:] != c[:-1])
        context = np.cumsum(head) - 1
        gone = ids > ids[np.flatnonzero(head)][context]
        if gone.any():
            k, a = keys[gone], at[gone]
            o = np.lexsort((a, k))
            k, a = k[o], a[o]
            s = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            yield _rows(0, k[s], k[s], np.zeros(len(s), np.int64), a, s)
        contexts = np.add.reduceat(head.astype(np.int64), np.flatnonzero(gram))[np.cumsum(gram) - 1]
        ask = ~gone & (contexts > 1)
        for kind, some in ((1, ask & (contexts <= MANY)), (2, ask & (contexts > MANY))):
            if some.any():
                k, x = keys[some], context[some]
                s = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])))
                yield _rows(kind, k[s], ids[some][s], h[some].view(np.int64)[s] << 8 | now & 255, at[some], s)

    for b in batches:
        for bucket, n, wide, same, first, blob in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if bucket == -1:
                a = np.frombuffer(blob, np.int64)
                yield _rows(0, np.array([first]), np.array([first]), np.zeros(1, np.int64), a, np.zeros(1, np.int64))
                continue
            if bucket != now:
                yield from done()
                held, now = [], bucket
            held.append(_unpack(n, wide, same, first, blob))
    yield from done()


def _rows(kind: int, keys, ids, grams, places: np.ndarray, starts: np.ndarray):
    offsets = pa.array(np.append(starts, len(places)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(ids), pa.array(grams), pa.ListArray.from_arrays(offsets, pa.array(places))], ["kind", "key", "id", "gram", "places"])


def _fetch(length: int, gram: int):
    """Contexts' bytes, with the route on which equal windows meet."""
    reach, half = length - gram, (length - gram) // 2

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["route", "id", "key", "context", "places"])

    def fetch(batches):
        out: list = []
        for b in batches:
            for i in range(b.num_rows):
                text = (b.column(1)[i].as_py() or "").encode()
                for ask in b.column(2)[i].as_py():
                    at = ask["places"][0]
                    low, high = max(0, at - reach), min(len(text), at + length)
                    row = (ask["id"], b.column(0)[i].as_py(), text[low:high], [p - (at - low) for p in ask["places"]])
                    if ask["kind"] == 1:
                        out.append((ask["gram"], *row))
                    else:  # a window reaches past its gram by half the rest on one side at least
                        if at - half >= 0:
                            out.append((_digest(b"l", text[at - half : at + gram]), *row))
                        if at + gram + half <= len(text):
                            out.append((_digest(b"r", text[at : at + gram + half]), *row))
                if len(out) >= SENT:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return fetch


def _digest(side: bytes, b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(side + b, digest_size=8).digest(), "little", signed=True)


def repeated_windows(contexts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of windows that also stand in a context of a smaller id."""
    sizes = np.array([len(c) for c in contexts])
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(firsts[-1], np.int64)
    body = np.ones(firsts[-1], bool)
    body[firsts[1:] - 1] = False
    text[body] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    whole = np.zeros(len(text), bool)
    room = firsts[1:][owner] - 1 - np.arange(len(text))
    whole[room >= length] = True
    found = []
    for at, lcp in suffix_order(text, length):
        run = np.cumsum(lcp < length)
        keep = whole[at]
        at, run = at[keep], run[keep]
        if not len(at):
            continue
        head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        who = ids[owner[at]]
        least = np.repeat(np.minimum.reduceat(who, head), np.diff(np.append(head, len(at))))
        found.append(at[who > least])
    at = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    return owner[at], at - firsts[owner[at]]


def _sort_shard(length: int):
    """(key, begins): windows of ``length`` bytes to cut, from the suffix arrays of shards."""

    def shard(rows):
        routes, ids, keys, contexts, places = zip(*rows, strict=True)
        which, at = repeated_windows(list(contexts), np.array(ids, np.int64), length)
        out: dict[int, list] = {}
        cuts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else []
        for s, e in zip(cuts, [*cuts[1:], len(which)], strict=True):
            k = which[s]
            out.setdefault(keys[k], []).append((np.array(places[k])[:, None] + at[s:e]).ravel())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([np.unique(np.concatenate(v)) for v in out.values()], pa.list_(pa.int64()))], ["key", "begins"])

    def sort(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != last and size > SHARD:  # routes are never parted
                    yield from shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows:
            yield from shard(rows)

    return sort


def _cut(length: int, gram: int, with_text: bool, id_type: pa.DataType):
    reach = length - gram

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, text, contexts, begins in zip(*(b.column(i) for i in range(4)), strict=True):
                data = (text.as_py() or "").encode()
                n = len(data)
                spans = []
                if contexts.is_valid and len(contexts):
                    p = contexts.values.flatten().to_numpy()
                    spans.append(np.stack([np.maximum(p - reach, 0), np.minimum(p + length, n)], axis=1))
                if begins.is_valid and len(begins):
                    p = begins.values.flatten().to_numpy()
                    spans.append(np.stack([p, p + length], axis=1))
                kept, removed, runs = data, 0, 0
                if spans:
                    s = np.concatenate(spans)
                    s = s[np.argsort(s[:, 0], kind="stable")]
                    reached = np.maximum.accumulate(s[:, 1])
                    head = np.flatnonzero(np.append(True, s[1:, 0] > reached[:-1]))
                    begin, end = s[head, 0], reached[np.append(head[1:], len(s)) - 1]
                    removed, runs = int((end - begin).sum()), len(head)
                    kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), n], strict=True))
                out.append((doc_id.as_py(), n, removed, runs, hashlib.sha256(kept).hexdigest(), *((kept,) if with_text else ())))
            types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), *((pa.binary(),) if with_text else ())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept",) if with_text else ())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return cut


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining
    bytes, kept) for each row.  Ids are integers; ``length`` is at most 255."""
    if not 0 < gram <= length <= 255:  # common prefixes travel in a byte
        raise ValueError(f"0 < gram <= length <= 255 expected, not {gram}, {length}")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = docs.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.col("id").isNull())).first()
    if counted[0] is None or (counted[0] == 1 and not counted[1]):
        docs = docs.withColumn("key", F.col("id").cast("long"))
    else:  # rows that share an id, or have none, are told apart by a key that is written down
        docs = written(docs.withColumn("key", F.monotonically_increasing_id()), "repeats-keyed")
    rank = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select("key", rank.alias("id"), "text").mapInArrow(frugal(_send(max(64, 4 * partitions), length, gram)), _SENT_SCHEMA)
    spread = F.when(F.col("bucket") == -1, F.xxhash64("first")).otherwise(F.xxhash64("bucket"))
    met = sent.repartition(partitions, spread).sortWithinPartitions("bucket").mapInArrow(frugal(_meet), "kind int, key long, id long, gram long, places array<long>")
    with batch_rows(spark, ROWS):
        met = written(met, "repeats-met")
    release_shuffles(spark)
    asked = met.where("kind > 0").groupBy("key").agg(F.collect_list(F.struct("kind", "id", "gram", "places")).alias("asks"))
    contexts = docs.select("key", "text").join(asked, "key").select("key", "text", "asks").mapInArrow(frugal(_fetch(length, gram)), "route long, id long, key long, context binary, places array<long>")
    windows = contexts.repartition(partitions, "route").sortWithinPartitions("route").mapInArrow(frugal(_sort_shard(length)), "key long, begins array<long>")
    with batch_rows(spark, ROWS):
        windows = written(windows, "repeats-windows")
    release_shuffles(spark)
    spans = met.where("kind = 0").select("key", "places", F.lit(None).cast("array<long>").alias("begins")).unionByName(windows.select("key", F.lit(None).cast("array<long>").alias("places"), "begins"))
    spans = spans.groupBy("key").agg(F.collect_list("places").alias("places"), F.collect_list("begins").alias("begins"))
    id_type = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = docs.join(spans, "key", "left").select("id", "text", "places", "begins")
    schema = f"doc_id {id_type.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return out.mapInArrow(frugal(_cut(length, gram, with_text, to_arrow_type(id_type))), schema)


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
