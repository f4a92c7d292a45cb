"""Benchmark decontamination over a distributed positional inverted index.

``index`` cuts the words of a corpus in segments of whole documents and stores
each segment's postings: every term, byte for byte, with the ascending
positions at which it stands.  Segments are rows of a table in the shared
folder, so the index is spread by document, a frequent term's list over all
segments that hold it, and a corpus is cut in words once for any number of
searches.

A search takes test phrases to the segments.  In a segment a phrase starts from
the postings of its rarest term there, moved by the term's offset; that list is
intersected with those of its other terms, moved by theirs, in order of rarity;
what is left are exact occurrences (``phrase_matches``).  ``near_matches`` gives
the places where all words of a phrase stand near each other.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  A window
is ``words`` consecutive words of an item; a shorter item is one window; an
item without words matches nothing.

Test items are collected, compiled and broadcast a block at a time, each of
about ``block_bytes`` of text at most (a larger item is a block of its own); the
findings of several blocks are written and united.  Texts beyond SEGMENT bytes
are indexed in pieces that overlap by ``REACH`` words, which bounds ``words`` and
``width``; the findings of a text's pieces are united.

Null texts have no words.  Null doc ids pass through; items without an id are
one item, listed as 'null'.  Repeated rows, of either table, change nothing but
that each document row gets its own result.  An empty benchmark finds nothing;
an empty document table gives an empty result.  Extra columns are ignored, and
kept by ``decontaminated`` whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batch_rows, beside, dropped, free_name, frugal, planes, table, unplanes, written

WINDOW, REACH = 10, 256
#: Bytes of benchmark text in a broadcast block; bytes of text in a segment; windows, and places of their rarest terms, handled at once.
BLOCK_BYTES, SEGMENT, WINDOWS, PLACES = 8 << 20, 2 << 20, 1 << 14, 1 << 20
#: Segments handed to Python at once.
SEGMENT_ROWS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[: 0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False


class Words:
    """The words of texts: where they begin in all texts joined, the first word
    of each text (and the number of all), each word's term, and the terms."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        word = _IS_WORD[data]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.begin, end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.begin, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        offsets = np.concatenate(([0], np.cumsum(end - self.begin))).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(end), [None, pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes())]).dictionary_encode()
        self.term, self.terms = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _pieces(text: bytes) -> Iterator[tuple[bytes, int, bool]]:
    """(piece, words of it that the piece before has too, whether more follow)."""
    start, end, again = 0, 0, 0
    while True:
        end = max(end, start) + SEGMENT
        while end < len(text) and _IS_WORD[text[end]]:
            end += 1
        piece = text[start:end]
        yield piece, again, end < len(text)
        if end >= len(text):
            return
        begin = Words([piece]).begin
        again = min(REACH, len(begin))
        start = start + int(begin[-again]) if again else end


#: A segment: its documents' row keys, ids, words, words that an earlier piece has, number of the first word, whether they are in pieces; its postings.
_SEGMENT = "keys array<long>, ids array<{}>, words array<long>, again array<long>, base array<long>, split array<boolean>, terms array<binary>, counts array<long>, places binary"


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of a corpus."""
    id_type = df.schema[id_col].dataType
    arrow = to_arrow_type(id_type)

    def one(x: pa.Array | list, kind: pa.DataType) -> pa.Array:
        values = x if isinstance(x, pa.Array) else pa.array(x, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def segment(docs: list[tuple], ids: pa.Array) -> pa.RecordBatch:
        found = Words([d[1] for d in docs])
        order = np.argsort(found.term, kind="stable")
        counts = np.bincount(found.term, minlength=len(found.terms))
        steps = np.diff(order, prepend=0)
        heads = np.cumsum(counts) - counts
        steps[heads] = order[heads]
        keys, _, again, base, split = zip(*docs, strict=True)
        arrays = [one(keys, pa.int64()), one(ids, arrow), one(np.diff(found.first), pa.int64()), one(again, pa.int64()), one(base, pa.int64()), one(split, pa.bool_()), one(found.terms, pa.binary()), one(counts, pa.int64()), pa.array([planes(steps.astype(np.uint64), 4)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["keys", "ids", "words", "again", "base", "split", "terms", "counts", "places"])

    def build(batches):
        key, held, ids, size = TaskContext.get().partitionId() << 40, [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                key, base = key + 1, 0
                for piece, again, more in _pieces(texts[i].as_py() or b""):
                    if size and size + len(piece) > SEGMENT:
                        yield segment(held, pa.concat_arrays(ids))
                        held, ids, size = [], [], 0
                    split = more or base > 0
                    held.append((key, piece, again, base - again, split))
                    ids.append(batch.column(0).slice(i, 1))
                    size += len(piece) + 1
                    if split:
                        base += len(Words([piece]).begin) - again
        if held:
            yield segment(held, pa.concat_arrays(ids))

    with batch_rows(df.sparkSession, 1000):
        return written(df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(frugal(build), _SEGMENT.format(id_type.simpleString())), "postings")


class Segment:
    """A segment's postings: ``places[starts[t] : starts[t + 1]]`` of term t."""

    def __init__(self, row: pa.RecordBatch):
        values = lambda name: row.column(name).flatten().to_numpy(zero_copy_only=False)
        self.keys, self.words, self.again, self.base, self.split = (values(c) for c in ("keys", "words", "again", "base", "split"))
        self.ids, self.terms = row.column("ids").flatten(), row.column("terms").flatten()
        self.counts = values("counts")
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        steps = unplanes(row.column("places")[0].as_py(), 4).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(steps)))
        self.places = total[1:] - np.repeat(total[self.starts[:-1]], self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.words)))
        self.doc = np.repeat(np.arange(len(self.words)), self.words)
        #: Term and place of each posting, ascending.
        self.keyed = np.repeat(np.arange(len(self.counts)), self.counts) << 32 | self.places

    def local(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """This segment's number of each term of a vocabulary (0 where it has none), and the length of its list."""
        at = pc.index_in(vocabulary, value_set=self.terms)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return at, np.where(known, self.counts[at], 0) if len(self.counts) else np.zeros(len(at), np.int64)

    def in_list(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = term << 32 | place
        at = np.minimum(np.searchsorted(self.keyed, want), len(self.keyed) - 1)
        return self.keyed[at] == want

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of several terms, one after the other: whose they are, and the places."""
        n = self.counts[term]
        k = np.repeat(np.arange(len(term)), n)
        return k, self.places[np.arange(n.sum()) + (self.starts[term] - np.cumsum(n) + n)[k]]


class Items:
    """Compiled test items: their distinct ids, terms, and words joined; the
    windows (first word, item) of each length."""

    def __init__(self, rows: list[tuple[str | None, str]], words: int = WINDOW):
        self.ids: list[str | None] = list(dict.fromkeys(i for i, _ in rows))
        number = {i: k for k, i in enumerate(self.ids)}
        found = Words([t.encode() for _, t in rows])
        self.vocabulary, self.term = found.terms, found.term.astype(np.int32)
        self.item, self.first = np.array([number[i] for i, _ in rows], np.int64), found.first
        sizes = np.diff(found.first)
        self.windows: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(sizes, words)).tolist():
            of = np.flatnonzero(np.minimum(sizes, words) == length)
            n = sizes[of] - length + 1
            row = np.repeat(np.arange(len(of)), n)
            if length:
                self.windows.append((length, found.first[of][row] + np.arange(n.sum()) - (np.cumsum(n) - n)[row], self.item[of][row]))

    def occurrences(self, segment: Segment) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, item, place of the first word) of the windows that occur."""
        local, counts = segment.local(self.vocabulary)
        for length, starts, item in self.windows:
            for s in range(0, len(starts), WINDOWS):
                terms = self.term[starts[s : s + WINDOWS, None] + np.arange(length)]
                sizes = counts[terms]
                possible = np.flatnonzero(sizes.min(axis=1) > 0)
                terms, own = local[terms[possible]], item[s : s + WINDOWS][possible]
                rank = np.argsort(sizes[possible], axis=1, kind="stable")
                fewest = np.cumsum(sizes[possible].min(axis=1))
                cuts = [0, *(np.searchsorted(fewest, np.arange(PLACES, fewest[-1], PLACES), "right")).tolist(), len(fewest)] if len(fewest) else []
                for a, b in itertools.pairwise(cuts):
                    if a < b:
                        k, at = self._intersect(segment, terms[a:b], rank[a:b])
                        yield length, own[a:b][k], at

    @staticmethod
    def _intersect(segment: Segment, terms: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, each = terms.shape[1], np.arange(len(terms))
        k, at = segment.lists(terms[each, rank[:, 0]])
        at = at - rank[k, 0]
        inside = (at >= 0) & (at + length <= len(segment.doc))
        k, at = k[inside], at[inside]
        same = segment.doc[at] == segment.doc[at + length - 1]
        k, at = k[same], at[same]
        for r in range(1, length):
            offset = rank[k, r]
            met = segment.in_list(terms[k, offset], at + offset)
            k, at = k[met], at[met]
        return k, at

    def near(self, segment: Segment, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places of its rarest word that have each other word within ``width`` words)."""
        local, counts = segment.local(self.vocabulary)
        for i, (a, b) in enumerate(itertools.pairwise(self.first.tolist())):
            terms = np.unique(self.term[a:b])
            if not len(terms) or counts[terms].min() == 0:
                continue
            terms = local[terms[np.argsort(counts[terms], kind="stable")]]
            _, at = segment.lists(terms[:1])
            for t in terms[1:]:
                low = np.maximum(at - width, segment.first[segment.doc[at]])
                high = np.minimum(at + width, segment.first[segment.doc[at] + 1] - 1)
                held = segment.places[segment.starts[t] : segment.starts[t + 1]]
                at = at[np.searchsorted(held, low) < np.searchsorted(held, high, "right")]
            yield int(self.item[i]), at


def item_blocks(benchmark: DataFrame, words: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[Items]:
    """The compiled items, block by block; the driver holds one."""
    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = b.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        yield Items([tuple(r) for r in (b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)).distinct().collect()], words)


def _searched(segments: DataFrame, items: Iterator[Items], search, schema: str) -> DataFrame:
    """What ``search(segment, items, first block)`` yields for each segment and block of items, written."""
    spark, parts = segments.sparkSession, []
    for block in items:
        sent, first = spark.sparkContext.broadcast(block), not parts

        def each(batches, sent=sent, first=first):
            for b in batches:
                for i in range(b.num_rows):
                    yield from search(Segment(b.slice(i, 1)), sent.value, first)

        with batch_rows(spark, SEGMENT_ROWS):
            parts.append(written(segments.mapInArrow(frugal(each), schema), "found"))
        sent.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.blocks = len(parts)
    return out


def _matches(segments: DataFrame, benchmark: DataFrame, words: int, find, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    id_type = segments.schema["ids"].dataType.elementType

    def search(segment, items, first):
        for item, at in find(segment, items):
            own = at - segment.first[segment.doc[at]] + segment.base[segment.doc[at]]
            yield pa.RecordBatch.from_arrays([pa.array(segment.keys[segment.doc[at]]), segment.ids.take(pa.array(segment.doc[at])), pa.array([items.ids[i] for i in item.tolist()], pa.string()), pa.array(own)], ["key", "doc_id", "item_id", "place"])

    schema = f"key long, doc_id {id_type.simpleString()}, item_id string, place long"
    # Pieces of a text overlap, and items may repeat.
    return _searched(segments, item_blocks(benchmark, words, block_bytes, id_col, text_col), search, schema).distinct().drop("key")


def phrase_matches(segments: DataFrame, benchmark: DataFrame, words: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, place: where a window of an item occurs (the number of its first word in the document)."""
    if words > REACH:
        raise ValueError(f"at most {REACH} words")
    return _matches(segments, benchmark, words, lambda s, items: ((own, at) for _, own, at in items.occurrences(s)), item_col, item_text_col, block_bytes)


def near_matches(segments: DataFrame, benchmark: DataFrame, width: int, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, place: an occurrence of an item's rarest word (in its
    part of the index) that has each other word of the item at most ``width``
    words away in the same document."""
    if 2 * width > REACH:
        raise ValueError(f"at most {REACH // 2} words")
    return _matches(segments, benchmark, WINDOW, lambda s, items: ((np.full(len(at), i), at) for i, at in items.near(s, width)), item_col, item_text_col, block_bytes)


def _found(segment: Segment, items: Items, every: bool) -> Iterator[pa.RecordBatch]:
    """Each document's hit words (as a count and as ranges) and items; only those with any, and no count of words, unless ``every``."""
    n = len(segment.doc)
    hits, pairs = np.zeros(n + 1, np.int64), []
    for length, item, at in items.occurrences(segment):
        np.add.at(hits, at, 1)
        np.add.at(hits, at + length, -1)
        pairs.append(np.unique(segment.doc[at] * len(items.ids) + item))
    hit = np.cumsum(hits)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[segment.first[1:]] - total[segment.first[:-1]]
    some = np.arange(len(n_hit)) if every else np.flatnonzero(n_hit)
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    owner, item = pairs // max(len(items.ids), 1), pairs % max(len(items.ids), 1)
    cut = np.searchsorted(owner, np.append(some, len(n_hit)))
    ranges = []
    for d in some.tolist():
        edges = np.flatnonzero(np.diff(hit[segment.first[d] : segment.first[d + 1]], prepend=False, append=False)) if n_hit[d] else []
        ranges.append((np.asarray(edges, np.int64) + segment.base[d]).tolist())
    arrays = [pa.array(segment.keys[some]), segment.ids.take(pa.array(some)), pa.array((segment.words - segment.again)[some] * every), pa.array(segment.split[some]), pa.array(n_hit[some]), pa.array(ranges, pa.list_(pa.int64())), pa.array([[items.ids[i] for i in item[a:b].tolist()] for a, b in itertools.pairwise(cut.tolist())], pa.list_(pa.string()))]
    yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "n_words", "split", "n_hit", "ranges", "items"])


def _united(ranges: list[list[list[int]]]) -> int:
    """Words in at least one of several lists of ranges [a, b, c, d, ...)."""
    ends = sorted((x, 1 - 2 * (i % 2)) for r in ranges for i, x in enumerate(r))
    n = depth = last = 0
    for x, step in ends:
        n += (x - last) * (depth > 0)
        depth, last = depth + step, x
    return n


def contamination(df: DataFrame, benchmark: DataFrame, words: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``df``."""
    if words > REACH:
        raise ValueError(f"at most {REACH} words")
    id_type = df.schema[id_col].dataType.simpleString()
    segments = index(df, id_col, text_col)
    schema = f"key long, doc_id {id_type}, n_words long, split boolean, n_hit long, ranges array<long>, items array<string>"
    found = _searched(segments, item_blocks(benchmark, words, block_bytes, item_col, item_text_col), _found, schema)
    dropped(segments)

    def unite(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([_united(x) for x in b.column(2).to_pylist()], pa.int64()), b.column(3)], ["doc_id", "n_words", "n_hit", "items"])

    apart = F.lit(found.blocks > 1) | F.col("split")
    # The first block of items reports every piece of every document, the others what they find.
    several = found.where(apart).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.collect_list("ranges").alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    several = several.select("doc_id", "n_words", "ranges", "items").mapInArrow(unite, f"doc_id {id_type}, n_words long, n_hit long, items array<string>")
    rows = found.where(~apart).select("doc_id", "n_words", "n_hit", "items").unionByName(several)
    names = F.array_sort(F.transform("items", lambda i: F.coalesce(i, F.lit("null"))))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` in which no test window occurs, with all their columns."""
    key = free_name("_row", df)
    rows = written(df.withColumn(key, F.monotonically_increasing_id()), "rows")
    bad = contamination(rows, benchmark, id_col=key, text_col=text_col, **options).where("contaminated").select(F.col("doc_id").alias(key))
    return rows.join(beside(written(bad, "bad")), key, "left_anti").select(*df.columns)


def op3_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CUT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH items AS (SELECT item_id, {_CUT} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_CUT}, []) AS w FROM documents),
grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
met AS (SELECT r, k, i, item_id FROM grams JOIN windows USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT coalesce(item_id, 'null'))) AS ids FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""
