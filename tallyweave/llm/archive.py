"""Content-addressed WARC archive.

Payload bytes are stored once each, as ``resource`` records of gzipped WARC
files whose address is the payload's SHA-256; exact record headers are stored
separately and name that address.  Reading takes the files apart record by
record (their lengths decide where a block ends), verifies each payload against
its address, and puts the original records together by a join of headers and
payloads; a revisit's record has an empty block.  What is said of a record is
measured in its block, for a revisit in that of the response it refers to, and
a length or digest that differs from the header's fails.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
largest id is a response and the others are revisits of it; records with
smaller payloads are all responses, though their bytes, too, are stored once.
A payload of very many responses meets its headers in parts.

Null html is an empty payload; a null url leaves out the target header; line
ends and control characters in a url are percent-encoded.  A record's id comes
from its row's id and payload; rows that repeat both are the same record again:
all responses if the id is the group's largest.  A group whose ids are all null
has responses only.  An empty table gives an empty archive.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

REVISIT_BYTES = 1000
#: Bytes aimed at in an archive file; headers that meet one copy of a payload; bytes of records handed on, and of a file unpacked, at once.
FILE_BYTES, PART, HANDED, UNPACKED = 32 << 20, 10_000, 8 << 20, 1 << 20
#: Time stamp of records whose table has none (fixed, so that headers are reproducible).
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """headers: header (exact text up to the empty line), digest (the payload's
    address), part.  path: the folder of the files that hold the payloads."""

    headers: DataFrame
    path: str


def _uuid(text: Column) -> Column:
    h = F.md5(text.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record_id(page_id: Column, digest: Column) -> Column:
    return _uuid(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), digest))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _files(records: DataFrame, path: str, most: int | None = None) -> None:
    """Write whole records (``value``, arbitrary bytes) as gzipped WARC files of at most ``most`` records."""
    out = records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    (out.option("maxRecordsPerFile", most) if most else out).text(path)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> Archive:
    payload = F.coalesce(F.col(payload_col), F.lit("").cast(pages.schema[payload_col].dataType)).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    meta = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), "n")
    held = meta.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
    meta = meta.join(held, "digest")
    large = F.col("n") >= revisit_bytes
    revisit = large & F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f\x7f]", "")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", url), _line("WARC-Page-ID", F.col("page_id")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("response_id"), F.col("digest"))), _line("WARC-Refers-To-Page-ID", F.col("response_id")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
    )
    parts = F.when(large, 1).otherwise(F.ceil(F.col("copies") / PART)).cast("int")
    part = F.pmod(F.xxhash64("page_id", "url"), parts).cast("int")
    headers = written(meta.select(header.alias("header"), "digest", part.alias("part")), "warc-headers")
    # Partial aggregation leaves one copy for each task, however many rows share a payload.
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.first("n").alias("n"), F.count("*").alias("copies"))
    stored = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"), _line("WARC-Record-ID", _uuid(F.col("digest"))), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.concat(F.lit("urn:sha256:"), F.col("digest"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _line("Parts", parts), F.lit("Content-Type: application/octet-stream\r\n"), _line("Content-Length", F.col("n")), F.lit("\r\n"),
    )
    mean = rows.agg(F.avg("n")).first()[0] or 0
    path = f"{shared_dir(pages.sparkSession)}/tallyweave/warc-{uuid.uuid4().hex}"
    _files(once.select(F.concat(stored.cast("binary"), "payload").alias("value")), path, max(1, int(FILE_BYTES / (mean + 400))))
    return Archive(headers, path)


def field(name: str, header: Column | str = "header") -> Column:
    """A header's value, or null where the record has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+) *\r\n", re.I)


def parsed(data: bytes, name: str = "archive") -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file's bytes, gzipped or not."""
    packed = data[:2] == b"\x1f\x8b"
    source, held, at = zlib.decompressobj(31), bytearray(), 0

    def more(need: int) -> bool:
        """Unpack until ``need`` bytes are held."""
        nonlocal source, held, at
        while len(held) < need:
            if at >= len(data):
                return False
            piece = data[at : at + UNPACKED]
            at += len(piece)
            while piece:
                held += source.decompress(piece) if packed else piece
                piece = source.unused_data if packed else b""
                if packed and source.eof:  # a file may have a gzip member for each record
                    source = zlib.decompressobj(31)
        return True

    while more(1):
        end, seen = -1, 0
        while end < 0:
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
            if end < 0 and not more(seen + 1):
                raise ValueError(f"damaged record in {name}: a header without an end")
        header = bytes(held[: end + 2])
        length = _LENGTH.search(header)
        if not header.startswith(b"WARC/") or not length:
            raise ValueError(f"damaged record in {name}: no record's header")
        whole = end + 4 + int(length[1]) + 4
        if not more(whole) or held[whole - 4 : whole] != b"\r\n\r\n":
            raise ValueError(f"damaged record in {name}: its block is shorter or longer than its length")
        yield header, bytes(held[end + 4 : whole - 4])
        del held[:whole]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header (bytes) and block of each record of the WARC files at ``path``.
    A task holds the packed bytes of its files, and unpacks them bit by bit."""

    def read(batches):
        rows, size = [], 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for record in parsed(content.as_py(), name):
                    rows.append(record)
                    size += sum(map(len, record))
                    if size > HANDED:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "header binary, block binary")


def stored(archive: Archive) -> DataFrame:
    """digest, parts, payload of each stored payload, verified: one that differs from its address fails."""

    def verify(batches):
        for b in batches:
            digests = [re.search(rb"\r\nWARC-Block-Digest: sha256:(\w+)\r\n", h)[1].decode() for h in b.column(0).to_pylist()]
            parts = [int(re.search(rb"\r\nParts: (\d+)\r\n", h)[1]) for h in b.column(0).to_pylist()]
            for digest, block in zip(digests, b.column(1), strict=True):
                if hashlib.sha256(block.as_buffer()).hexdigest() != digest:
                    raise ValueError(f"damaged payload {digest}")
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(parts, pa.int32()), b.column(1)], ["digest", "parts", "payload"])

    return read_warc(archive.headers.sparkSession, archive.path).mapInArrow(verify, "digest string, parts int, payload binary")


def records(archive: Archive) -> DataFrame:
    """The original records: header, block (a revisit's is empty)."""
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    revisit = field("WARC-Type") == "revisit"
    full = archive.headers.where(~revisit).join(stored(archive).select("digest", "payload", parts), ["digest", "part"]).select("header", F.col("payload").alias("block"))
    return full.unionByName(archive.headers.where(revisit).select("header", F.lit("").cast("binary").alias("block")))


def write_warc(archive: Archive, path: str) -> None:
    """Gzipped WARC files of the whole records."""
    _files(records(archive).select(F.concat(F.col("header").cast("binary"), F.lit("\r\n").cast("binary"), "block").alias("value")), path)


def digests(archive: Archive) -> DataFrame:
    """What reading the archive back gives for each record."""
    length, digest = F.octet_length("block").cast("long"), F.sha1("block")
    whole = length.eqNullSafe(field("Content-Length").cast("long")) & ((field("WARC-Type") == "revisit") | F.concat(F.lit("sha1:"), digest).eqNullSafe(field("WARC-Payload-Digest")))
    kind = F.when(whole, field("WARC-Type")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), field("WARC-Record-ID"))).cast("string"))
    read = written(
        records(archive).select(
            field("WARC-Page-ID").cast("long").alias("page_id"), kind.alias("record_type"), length.alias("payload_bytes"), digest.alias("payload_digest"), field("WARC-Record-ID").alias("record_id"),
            field("WARC-Refers-To").alias("refers_to_id"), field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        ),
        "warc-read",
    )
    own = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    said = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(said, "refers_to_id", "left")
    return own.unionByName(again.select(*own.columns))


def op4_warc(spark, sf_dir):
    return digests(write_archive(table(spark, sf_dir, "pages")))


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY h) END AS r FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN r <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to FROM w
"""
