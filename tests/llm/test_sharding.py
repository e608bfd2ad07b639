"""Histogram-sort shards against sorting all rows."""

import pytest
from pyspark.sql import functions as F

from seawake.llm.common import utf8
from seawake.llm.sharding import packed_keys, shard_by_bytes


def placed(df, shards=40, **k):
    body = utf8()
    return shard_by_bytes(df, shards, F.octet_length(body) + 16, F.xxhash64(body), **k).toPandas()


def is_gapless(p):
    g = p.groupby("shard").slot
    assert (g.max() + 1 == g.size()).all() and (g.nunique() == g.size()).all() and (g.min() == 0).all()


def test_packed_keys_sort_like_tuples():
    rows = [(-5, 3, 0), (-5, -3, 9), (7, 0, -1), (0, 0, 0), (-(1 << 63), 1, 1)]
    keys = packed_keys(*zip(*rows)).tolist()
    assert sorted(range(5), key=lambda i: keys[i].ljust(24, b"\0")) == sorted(range(5), key=lambda i: rows[i])


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_near_equal(given, shards):
    docs = given("documents")
    p = placed(docs, shards)
    assert len(p) == docs.count() and p["shard"].between(0, shards - 1).all()
    is_gapless(p)
    sizes = p.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    share, largest = p["size"].sum() / shards, p["size"].max()
    assert (abs(sizes - share) <= largest + 0.002 * share).all()


def test_hot_copies_are_split(spark):
    """A third of all rows are one text: its rows fill several shards, all near equal."""
    rows = [(i, "the same text " * 5 if i % 3 == 0 else f"text {i} " * 9) for i in range(3000)]
    p = placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 10)
    is_gapless(p)
    sizes = p.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 3 * p["size"].max()
    assert p[p.doc_id % 3 == 0]["shard"].nunique() in (3, 4, 5)


def test_awkward(spark, docs, repeated, none):
    for df in (docs, repeated):
        p = placed(df.withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1)), 4)
        assert len(p) == df.count()
        is_gapless(p)
    assert len(placed(none)) == 0
    same = spark.createDataFrame([(1, "row")] * 1000, "doc_id long, text string")
    p = placed(same, 8)
    assert p.groupby("shard").size().between(124, 126).all()
