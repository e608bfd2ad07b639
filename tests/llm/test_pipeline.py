"""Every pipeline stage on its own input, and all of them."""

import collections

import pytest

import corpus_pipeline as cp
from llm.conftest import SF
from llm.test_near_duplicates import brute
from seawake.llm.common import stored
from seawake.llm.decontamination import benchmark_overlaps


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns(steps):
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [len(cp.STAGES), list(steps)] == [5, ["toxicity", "jaccard_join", "decontamination", "mixing", "sharding"]]
    for name, (_, after) in steps.items():
        assert after.columns == want + (["size", "shard", "slot"] if name == "sharding" else [])


def test_toxicity_keeps_most(steps):
    before, after = steps["toxicity"]
    assert set(ids(after)) < set(ids(before)) and len(ids(after)) > 0.8 * len(ids(before))


def test_one_of_each_group(steps):
    before, after = steps["jaccard_join"]
    top = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(ids(after)) == sorted(d for d, c in top.items() if d == c)


def test_no_leak_is_left(steps, given):
    before, after = steps["decontamination"]
    bad = {r.doc_id for r in benchmark_overlaps(before, given("benchmark")).collect()}
    assert bad and sorted(ids(after)) == sorted(set(ids(before)) - bad)


def test_mix_keeps_and_repeats(steps):
    before, after = steps["mixing"]
    copies = collections.Counter(ids(after))
    assert set(copies) == set(ids(before)) and max(copies.values()) <= 5


def test_shards_hold_all(steps):
    before, after = steps["sharding"]
    assert sorted(ids(after)) == sorted(ids(before))
    p = after.select("size", "shard", "slot").toPandas()
    sizes = p.groupby("shard")["size"].sum().reindex(range(cp.SHARDS), fill_value=0)
    assert (abs(sizes - p["size"].sum() / cp.SHARDS) <= 1.01 * p["size"].max()).all()


def test_run(spark, steps):
    assert sorted(ids(cp.run(spark, SF))) == sorted(ids(steps["sharding"][1]))
