"""Columns of the input named like those the operators work with."""

from pyspark.sql import functions as F

from seawake.llm import mixing, sharding, toxicity
from seawake.llm.common import utf8

NAMES = ("key", "epochs", "cutoff", "tokens", "row", "body", "_key", "_place", "_n", "_h", "_d", "_r", "_size", "_part", "_body")


def test_extra_columns_come_back_unchanged(docs, given):
    wide = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    model = toxicity.train(given("documents"), given("labels"))
    size = F.octet_length(utf8()) + 16
    for run, added in (
        (lambda d: sharding.shard_by_bytes(d, 3, size, F.xxhash64(utf8())), {"size", "shard", "slot"}),
        (lambda d: mixing.mix(d), {"epoch", "block", "place", "weight"}),
        (lambda d: toxicity.score_documents(d, model), {"score"}),
    ):
        out = run(wide)
        assert set(out.columns) == set(wide.columns) | added
        kept = out.select(wide.columns)
        assert kept.exceptAll(wide.unionAll(wide).unionAll(wide).unionAll(wide)).isEmpty()
        assert wide.exceptAll(kept).isEmpty()
        plain = run(docs)
        assert out.select(plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(out.select(plain.columns)).isEmpty()
