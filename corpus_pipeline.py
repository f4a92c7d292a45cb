"""The corpus pipeline: documents in, shards out.

quality classifier -> SimHash near-dedup -> benchmark decontamination ->
mixing to target weights -> sharding.  Each stage takes (spark, docs, sf_dir)
and works on all that the stage before it kept; all but the last return the
columns of ``documents``.

* quality: drops documents that the rule ensemble scores below 0.5;
* near-dedup: five-word shingles, similarity 0.8 or more; one document of each
  group stays, the one with the least id;
* decontamination: drops documents in which a benchmark window occurs;
* mixing: each document at least once, documents of sources whose target weight
  exceeds their share again in later epochs;
* sharding: the shard and slot of each row (not its text), under the law
  ``bytes``.

Null texts and ids, empty and very long texts, ties, repeated rows, empty
tables and extra columns behave as the operators' docstrings say; extra columns
travel along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import decontaminate, mixing, quality, sharding, simhash
from tallyweave.llm.common import table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontaminate_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [("quality", classify), ("near-dedup", deduplicate), ("decontamination", decontaminate_), ("mixing", mix), ("sharding", shard)]

#: A trained classifier and similarity groups are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
