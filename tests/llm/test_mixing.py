"""Temperature mixing against working it out by hand."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from seawake.llm.mixing import Recipe, _place, mix, plan_mix, word_tokens

TOKENS = {"a": 60_000, "b": 6_000, "c": 3_000, None: 900}


@pytest.fixture(scope="module")
def sources(spark):
    rows, i = [], 0
    for s, n in TOKENS.items():
        while n > 0:
            k = min(n, 10 + i * 7 % 90)
            rows.append((i, "w " * k, s))
            i, n = i + 1, n - k
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def weights(alpha):
    x = {s: n**alpha for s, n in TOKENS.items()}
    return {s: v / sum(x.values()) for s, v in x.items()}


def entropy(w):
    return -sum(p * math.log(p) for p in w.values()) / math.log(len(w))


def mixed(df, recipe):
    return mix(df, recipe).withColumn("t", word_tokens()).collect()


def test_entropy_target(sources):
    total = sum(TOKENS.values())
    rows = mixed(sources, Recipe(entropy=0.7, repeats=1000, budget=total))
    weight = {r.source: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1) and entropy(weight) == pytest.approx(0.7, abs=1e-4)
    got = collections.Counter()
    for r in rows:
        got[r.source] += r.t
    for s, w in weight.items():
        assert 0 <= w * total - got[s] <= 100, s  # short by less than one document


def test_repetition_limit_binds(sources):
    total = sum(TOKENS.values())
    rows = mixed(sources, Recipe(entropy=1.0, repeats=3.0, budget=total))
    weight = {r.source: r.weight for r in rows}
    assert weight[None] * total / TOKENS[None] == pytest.approx(3.0, abs=1e-3)
    assert max(r.epoch for r in rows) == 2


def test_no_budget_keeps_every_document(sources):
    rows = mixed(sources, Recipe(entropy=0.6, repeats=4.0))
    copies = collections.Counter(r.doc_id for r in rows)
    assert set(copies) == {r.doc_id for r in sources.collect()}
    source = {r.doc_id: r.source for r in rows}
    for s in TOKENS:
        n = {copies[d] for d in copies if source[d] == s}
        assert max(n) - min(n) <= 1 and max(n) <= 5
    assert {copies[d] for d in copies if source[d] == "a"} == {1}


def test_partial_epoch_is_a_prefix_of_its_permutation(sources):
    recipe = Recipe(entropy=0.7, repeats=1000, budget=sum(TOKENS.values()))
    rows = mixed(sources, recipe)
    plan = {r.key: r for r in plan_mix(sources, recipe, word_tokens()).collect()}
    place = {r.doc_id: (r.source, r.p) for r in sources.select("doc_id", "source", _place(recipe.seed).alias("p")).collect()}
    for source, key in (("a", "=a"), ("b", "=b"), (None, "")):
        last = {r.doc_id for r in rows if r.source == source and r.epoch == plan[key].epochs}
        assert last == {d for d, (s, p) in place.items() if s == source and p <= plan[key].cutoff}
    for s in ("a", "b"):
        for e in range(2):
            places = [r.place for r in rows if r.source == s and r.epoch == e]
            assert len(places) == len(set(places))
            assert [p >> 51 for p in places] == [r.block for r in rows if r.source == s and r.epoch == e]


def test_awkward(docs, repeated, none):
    for df in (docs, repeated):
        out = mix(df.withColumn("place", F.lit("clash")))
        assert out.columns == [*df.columns, "epoch", "block", "place", "weight"]
        ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
        assert ids(out) == ids(df)
    assert mix(none).count() == 0
    assert mix(docs.where("doc_id in (4, 5, 6)")).count() == 3


def even_sources(spark, tokens):
    rows = [(s, i) for s, n in tokens.items() for i in range(n // 10)]
    df = spark.createDataFrame([(k, "w " * 10, s) for k, (s, _) in enumerate(rows)], "doc_id long, text string, source string")
    return df, sum(tokens.values())


def test_entropy_target_below_that_of_the_sources(spark):
    tokens = {"a": 2000, "b": 2100, "c": 2200, "d": 2400}
    df, total = even_sources(spark, tokens)
    share = {s: n / total for s, n in tokens.items()}
    assert entropy(share) > 0.99
    weight = {r.source: r.weight for r in mixed(df, Recipe(entropy=0.9, repeats=1000, budget=total))}
    assert sum(weight.values()) == pytest.approx(1) and entropy(weight) == pytest.approx(0.9, abs=1e-4)
    # one source no more than 1.2 times: the sharpest mix that keeps to it
    weight = {r.source: r.weight for r in mixed(df, Recipe(entropy=0.9, repeats=1.2, budget=total))}
    assert max(weight[s] / share[s] for s in tokens) == pytest.approx(1.2, abs=1e-3)
    # without a budget every document stays
    assert {r.doc_id for r in mixed(df, Recipe(entropy=0.9, repeats=4.0))} == set(range(total // 10))


def test_equal_sources_cannot_be_sharpened(spark):
    df, total = even_sources(spark, {"a": 500, "b": 500, "c": 500})
    with pytest.warns(UserWarning, match="no exponent"):
        rows = mixed(df, Recipe(entropy=0.9, repeats=4.0, budget=total))
    assert sorted(r.doc_id for r in rows) == list(range(total // 10))
    df, total = even_sources(spark, {"a": 400, "b": 400, "c": 200})  # the two largest alone have 0.63
    with pytest.warns(UserWarning, match="no exponent"):
        assert len(mixed(df, Recipe(entropy=0.5, repeats=4.0, budget=total))) == total // 10
