"""The pipeline, stage by stage, against brute force over all rows of its input."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tallyweave.llm import mixing, quality

from .test_documents_ops import components, contaminated, jaccard, sharded, statistics

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def mixed(rows, period=mixing.PERIOD, block=mixing.BLOCK_ROWS, alpha=mixing.ALPHA):
    """How often each row is served: slot by slot, the released block with the earliest deadline."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"] or ""].append(r)
    names = sorted(by)
    for name in names:
        by[name].sort(key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
    powers = np.array([float(len(by[n])) ** alpha for n in names])
    due = powers / powers.sum() * (period - len(names))
    units = 1 + np.floor(due).astype(int)
    for i in sorted(range(len(names)), key=lambda i: (-(due[i] - np.floor(due[i])), names[i]))[: int(period - units.sum())]:
        units[i] += 1
    done, served, whole, t = [0] * len(names), Counter(), set(), 0
    while len(whole) < len(names):
        # Within each period the schedule starts anew.
        base, in_period = t // period, t % period
        open_ = [i for i in range(len(names)) if done[i] - base * units[i] < units[i] and (done[i] - base * units[i]) * period // units[i] <= in_period]
        i = min(open_, key=lambda i: (-(-(done[i] - base * units[i] + 1) * period // units[i]), i))
        blocks = -(-len(by[names[i]]) // block)
        at = done[i] % blocks
        for r in by[names[i]][at * block : (at + 1) * block]:
            served[r["doc_id"]] += 1
        done[i] += 1
        t += 1
        if done[i] >= blocks:
            whole.add(i)
    return served


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, now, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in now.collect()]
        out = stage(spark, now, DATA)
        after = [r.asDict() for r in out.collect()]
        if name != "sharding":
            assert out.columns == columns
        ids, got = {r["doc_id"] for r in before}, Counter(r["doc_id"] for r in after)
        if name == "quality":
            rules = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            s = {r["doc_id"]: statistics(r["text"]) for r in before}
            want = {i for i in ids if rules.bias + sum(w for w, c in rules.terms if all((s[i][n[3:]] > cut) == above for n, above, cut in c)) >= 0}
            assert set(got) == want and 0 < len(want) < len(ids)
        elif name == "near-dedup":
            texts = sorted((r["doc_id"], r["text"]) for r in before)
            links = [(a, b) for k, (a, x) in enumerate(texts) for b, y in texts[:k] if jaccard(x, y) >= 0.8]
            group = components(ids, links)
            # One of each group at least, and of all that brute force joins none but one.
            assert {group[i] for i in got} == set(group.values())
            assert len(got) - len(set(group.values())) <= 0.02 * len(links) and len(got) < len(ids)
        elif name == "decontamination":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(got) == {c[0] for c in contaminated([(r["doc_id"], r["text"]) for r in before], items) if not c[-1]} and len(got) < len(ids)
        elif name == "mixing":
            assert got == mixed(before)
        else:
            want = Counter(map(str, sharded([(r["doc_id"], r["text"]) for r in before], 16, "bytes")))
            assert Counter(str((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])) for r in after) == want
        kept[name] = len(after)
        now = spark.createDataFrame(after, out.schema)
    assert corpus_pipeline.run(spark, DATA).count() == kept["sharding"]


def test_stages_keep_awkward_columns_and_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("CASE WHEN doc_id % 5 > 0 THEN doc_id END AS doc_id", "text", "lang", "source", "n_chars", "1 AS _row", "2 AS _text", "3 AS _n", "4 AS node", "5 AS key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, docs, DATA)
        assert now.columns == docs.columns
        if name != "mixing":
            assert {r["text"] for r in now.select("text").collect()} <= {r["text"] for r in docs.select("text").collect()}
