import glob
import gzip
import hashlib
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tallyweave.llm import archive, embeddings
from tallyweave.llm.queries import ORACLE_SQL, QUERIES

# Archive ------------------------------------------------------------------------------------------------------------

LONG = "<p>é" + "y" * 1200
PAGES = [(1, "http://a/1", LONG, "x"), (2, "http://a/2\r\nX: y", LONG, "x"), (5, None, LONG, "x"), (3, "http://a/3", "short", "x"), (4, "http://a/4", "short", "x"), (6, "http://a/6", None, "x"), (None, "http://a/7", LONG, "x"), (8, "u", "z" * 1000, "x"), (8, "u", "z" * 1000, "x")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")


def test_archive_reads_back(spark, pages, tmp_path):
    a = archive.write_archive(pages)
    got = sorted(map(tuple, archive.digests(a).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, t, _ in PAGES:
        n = len((t or "").encode())
        revisit = t == LONG and i != 5
        want.append((i, n, sha(t), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)
    assert archive.stored(a).count() == len({t or "" for _, _, t, _ in PAGES})
    whole = archive.records(a).collect()
    assert len(whole) == len(PAGES) and all("\r\nX: y" not in r["header"] for r in whole)
    archive.write_warc(a, str(tmp_path / "warc"))
    back = archive.read_warc(spark, str(tmp_path / "warc" / "part-*")).collect()
    assert sorted((bytes(r["header"]).decode(), bytes(r["block"])) for r in back) == sorted((r["header"], bytes(r["block"])) for r in whole)


def test_arbitrary_bytes_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PART", 2)
    monkeypatch.setattr(archive, "HANDED", 100)
    monkeypatch.setattr(archive, "UNPACKED", 7)
    rng = np.random.default_rng(3)
    blobs = [rng.bytes(int(n)) for n in rng.integers(0, 3000, 20)] + [b"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3, b"", b"", b"", b"\xff\xfe\x00"]
    pages = spark.createDataFrame([(i, "u", bytearray(b)) for i, b in enumerate(blobs)], "page_id long, url string, html binary")
    a = archive.write_archive(pages)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in archive.digests(a).collect()}
    assert got == {i: (len(b), hashlib.sha1(b).hexdigest()) for i, b in enumerate(blobs)}
    archive.write_warc(a, str(tmp_path / "warc"))
    back = archive.read_warc(spark, str(tmp_path / "warc" / "part-*")).collect()
    assert sorted(bytes(r["block"]) for r in back) == sorted(blobs)


def test_damage_is_found(spark, pages):
    a = archive.write_archive(pages)
    file = next(f for f in glob.glob(f"{a.path.removeprefix('file:')}/part-*") if len(gzip.open(f).read()) > 1000)
    data = gzip.open(file).read()
    for bad, said in ((data.replace(b"yyy", b"yxy", 1), "damaged payload"), (data[:-1], "shorter or longer"), (data[:-8], "shorter or longer"), (data.replace(b"Content-Length: ", b"Content-Length: x", 1), "no record's header"), (data + b"WARC/1.1", "without an end")):
        with gzip.open(file, "wb") as f:
            f.write(bad)
        os.remove(f"{os.path.dirname(file)}/.{os.path.basename(file)}.crc") if os.path.exists(f"{os.path.dirname(file)}/.{os.path.basename(file)}.crc") else None
        with pytest.raises(Exception, match=said):
            archive.digests(a).collect()


def test_empty_archive(pages):
    assert archive.digests(archive.write_archive(pages.where("false"))).count() == 0


# Embeddings ---------------------------------------------------------------------------------------------------------


def _vectors(n=1500, dim=32):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, dim))
    noise = rng.standard_normal((200, dim))
    near = x[:200] + 0.35 * noise * np.linalg.norm(x[:200], axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    clique = x[300] + 0.05 * rng.standard_normal((150, dim))
    return np.concatenate([x, near, clique, x[400:410]])


@pytest.mark.parametrize("part", [1024, 64])
def test_recall_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(embeddings, "PART", part)
    monkeypatch.setattr(embeddings, "LEAF", 128)
    x = _vectors().astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 7, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, node long")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    degree = (u @ u.T >= 0.9).sum(1) - 1
    n_links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n_links <= degree).all() and n_links.sum() >= 0.95 * degree.sum()
    assert len({got[i]["component_id"] for i in range(1700, 1850)}) == 1
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


@pytest.mark.parametrize("depth", [7, 11])
@pytest.mark.parametrize("cosine", [0.905, 0.93])
def test_recall_in_a_dense_group(depth, cosine):
    rng = np.random.default_rng(depth)
    n, dim = 16 * 2**depth, 64
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = unit(rng.standard_normal((n, dim)))
    hot = rng.permutation(n)[: n // 3]
    x[hot] = unit(x[hot[:1]] + np.sqrt(1 / cosine - 1) * unit(rng.standard_normal((len(hot), dim))))
    a, b = rng.choice(hot, (2, 20_000))
    linked = (a != b) & ((x[a] * x[b]).sum(1) >= 0.9)
    a, b = a[linked], b[linked]
    met = np.zeros(len(a), bool)
    for _ in range(embeddings.TREES):
        rows, leaf = embeddings.Tree(x, depth, rng).leaves(x)
        assert len(rows) < 12 * n
        ends = np.searchsorted(np.sort(rows), np.arange(n + 1))
        ordered = leaf[np.argsort(rows, kind="stable")]
        width = np.diff(ends).max()
        lists = np.full((n, width), -1)
        lists[np.repeat(np.arange(n), np.diff(ends)), np.arange(len(rows)) - np.repeat(ends[:-1], np.diff(ends))] = ordered
        for c in range(width):
            met |= (lists[a, c] >= 0) & (lists[b] == lists[a, c][:, None]).any(axis=1)
    assert met.mean() >= 0.9


def test_links_of_a_dense_leaf(monkeypatch):
    rng = np.random.default_rng(1)
    x = embeddings._unit(rng.standard_normal(16) + 0.3 * rng.standard_normal((300, 16)))
    weight, part = rng.integers(1, 4, 300), rng.integers(0, 2, 300)
    leaves = np.sort(rng.integers(-1, 9, (300, 3)), axis=1)
    for across in (False, True):
        pair = (x @ x.T >= 0.9) & ~np.eye(300, dtype=bool) & ((part[:, None] != part) | (not across))
        before = ((leaves[:, None, :, None] == leaves[None, :, None, :]) & (leaves[:, None, :, None] >= 0) & (leaves[:, None, :, None] < 5)).any((2, 3))
        for pairs in (0, 1 << 15):
            monkeypatch.setattr(embeddings, "PAIRS", pairs)
            counts, labels = embeddings.leaf_links(x, weight, part, leaves, 5, across, 0.9)
            assert (counts == (pair & ~before) @ weight).all()
            assert (labels == embeddings.local_components(300, *np.nonzero(pair))).all()


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (2, [2.0, 0.01]), (None, [1.0, 0.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect())
    alone = [(str(i), 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([("1", 3, 1), ("2", 3, 1), ("2", 3, 1), ("None", 3, 1), *alone])
    assert embeddings.near_duplicates(df.where("false")).count() == 0


# Queries and the pipeline --------------------------------------------------------------------------------------------

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
