"""What a task holds in Python does not follow from the size of a split or from what other tasks left."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seawake.llm import decontamination as dc
from seawake.llm import ids
from seawake.llm import near_duplicates as nd
from seawake.llm import toxicity as tx

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbound(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def sizes(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    return [tuple(r) for r in docs.mapInArrow(run, "n long, size long").collect()]


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: tx.score_documents(d, tx.Model(b"", b"", 0.5)),
        lambda d: nd.jaccard_components(d.limit(2)),
        lambda d: dc.benchmark_overlaps(d.limit(2), d.sparkSession.createDataFrame([(1, "a b")], "item_id long, text string")),
        lambda d: ids.with_bit(d, "doc_id", np.zeros(ids.ID_BITS // 32 + 1, np.uint32)),
    ],
    ids=["toxicity", "near_duplicates", "decontamination", "ids"],
)
def test_batches_of_texts_are_small(unbound, operator):
    docs = unbound.range(0, 200, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    operator(docs)
    found = sizes(docs)
    assert sum(n for n, _ in found) == 200
    assert max(size for _, size in found) < 5 << 20  # 20 MB lie in the partition


def test_a_given_bound_stays(unbound):
    unbound.conf.set(KEY, "1m")
    tx.score_documents(unbound.createDataFrame([(1, "a")], "doc_id long, text string"), tx.Model(b"", b"", 0.5))
    assert unbound.conf.get(KEY) == "1m"


@pytest.mark.parametrize("step", ["describe", "index", "sets", "regions"])
def test_words_are_forgotten_after_a_task(step):
    held = SimpleNamespace(value={"index": nd.Frequencies([]), "sets": np.full(ids.ID_BITS // 32 + 1, 0xFFFFFFFF, np.uint32)}.get(step))
    field = SimpleNamespace(value=np.zeros(1 << (dc.FIELD_BITS - 5), np.uint32))
    run = {
        "describe": nd._describe(3),
        "index": nd._index(3, 80, held),
        "sets": nd._sets(3, held),
        "regions": dc._regions(field, dc.masks_of(15), 15),
    }[step]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"one two three four five"])], names=["doc_id", "body"])
    nd._memo.clear()
    out = run(iter([batch]))
    first = next(out, None)
    assert nd._memo or step == "regions" and first is None
    list(out)
    assert not nd._memo
