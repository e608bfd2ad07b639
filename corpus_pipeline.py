"""The corpus pipeline: from documents to cleaned, mixed and sharded training text.

Each stage gets all that its predecessor kept, as a Parquet table.  All but the last return the columns of
``documents``; the last adds ``size``, ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.llm.common import read_table, stored, utf8
from seawake.llm.decontamination import decontaminate
from seawake.llm.mixing import Recipe, mix
from seawake.llm.near_duplicates import keep_one
from seawake.llm.sharding import shard_by_bytes
from seawake.llm.toxicity import score_documents, train

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("score < 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles one stays."""
    return keep_one(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once; sources with too small a weight again, at most four times."""
    return mix(docs, Recipe(entropy=0.95, repeats=4.0, budget=None)).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near equal bytes per shard, equal texts together where the borders allow it."""
    body = utf8()
    return shard_by_bytes(docs, SHARDS, F.octet_length(body) + 16, F.xxhash64(body))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: training a model, similarity components and permutations have no SQL form; tests hold every stage
#: against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
