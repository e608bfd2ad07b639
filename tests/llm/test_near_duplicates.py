"""The n-gram Jaccard join, its index keys and the components against all pairs."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seawake.llm import near_duplicates as nd
from seawake.llm.components import connected

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, width, percent):
    sets = collections.defaultdict(set)
    for doc, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        if doc is not None:
            sets[doc].add(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def components(df, **k):
    return {r.doc_id: r.component_id for r in nd.jaccard_components(df, **k).where("doc_id is not null").collect()}


def frequencies(**counts):
    f = nd.Frequencies([])
    f.frequent = counts.pop("frequent", 64)
    return f


@pytest.mark.parametrize("percent", [70, 80, 90])
@pytest.mark.parametrize("common", [0.0, 0.5, 1.0])
def test_similar_sets_share_a_key(percent, common):
    """Whatever part of the shingles is called frequent."""
    r = np.random.default_rng(int(common * 10) + percent)
    f = frequencies()
    f.counts[: int(common * len(f.counts))] = 1000
    for n in [*range(1, 60), 100, 690, 705, 990, 1010, 1500, 12_500, 15_990, 16_010]:
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        miss = n - nd.least_overlap(n, percent)
        for k in {miss, miss // 2, 1}:
            if 0 < k <= miss:
                y = np.unique(np.r_[r.permutation(x)[k:], r.integers(0, 1 << 63, k // 3).astype(np.uint64)])
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    assert len(np.intersect1d(nd.index_keys(x, f, percent), nd.index_keys(y, f, percent)))


def test_given_documents(given):
    docs = given("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert components(docs) == brute(rows, 3, 90)


def test_awkward(docs, repeated, none):
    for df in (docs, repeated):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        for width, percent in ((3, 90), (5, 80)):
            assert components(df, width=width, percent=percent) == brute(rows, width, percent)
        assert nd.jaccard_components(df).count() == df.count()
    assert nd.jaccard_components(none).count() == 0
    with pytest.raises(ValueError):
        nd.jaccard_components(docs, percent=60)


@pytest.fixture(scope="module")
def chain(spark):
    """A hot group of near copies, each a few words off its neighbour: linked through others only."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(words)
        for _ in range(1 + i % 3):
            words[r.randrange(120)] = f"n{r.random()}"
        rows.append((i, " ".join(words)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_blocks_change_nothing(chain, block, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", block)  # large groups: leader first, then blocks
    monkeypatch.setattr(nd, "FREQUENT_LEAST", 8)
    rows = [(r.doc_id, r.text) for r in chain.collect()]
    assert components(chain) == brute(rows, 3, 90)


@pytest.mark.parametrize("columns", [8, 8192])
def test_similar_forest(columns, monkeypatch):
    monkeypatch.setattr(nd, "COLUMNS", columns)
    r = np.random.default_rng(columns)
    sets = [np.unique(r.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)] + [np.arange(3, dtype=np.uint64)]
    docs, comps, blocks = np.arange(41), np.arange(41), np.arange(41) % 2
    comps[7] = 3
    for own in (np.zeros(41), blocks):
        links = nd.similar_forest(docs, comps, own, sets, 60)
        good = {
            (i, j) for i in range(41) for j in range(i + 1, 41)
            if (own[i] != own[j] or own.max() == 0) and comps[i] != comps[j]
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
        }
        assert set(links) <= good

        def labels(edges):
            top = list(range(41))
            for _ in range(41):
                for a, b in [*edges, (3, 7)]:
                    top[a] = top[b] = min(top[a], top[b])
            return top

        assert labels(links) == labels(good) and len(links) < 41


def test_keep_one(repeated):
    kept = nd.keep_one(repeated.withColumn("n", F.lit("clash")), width=3, percent=90)
    assert kept.columns == [*repeated.columns, "n"]
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and ids.count(None) == 2
    assert {1, 4, 5, 6, 7, 9}.issubset(ids) and not {2, 3, 8}.intersection(ids)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (201, 200), (200, 201)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 120)}, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_signatures_never_part_similar_sets(percent):
    """They differ in no more bits than the sets in shingles, also where the longer one is folded."""
    r = np.random.default_rng(percent)
    for n in [2, 3, 10, 200, 255, 256, 257, 300, 511, 513, 1020, 1030, 3000]:
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, n).astype(np.uint64))
        sets = [x, np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))]
        for gone, more in ((0, n // 3), (n // 20, n // 20), (n // 8, n // 50), (n // 4, 0)):
            sets.append(np.unique(np.r_[r.permutation(x)[gone:], r.integers(0, 1 << 63, more).astype(np.uint64)]))
        near = nd.may_be_similar(np.array(list(map(len, sets))), [nd.signature(s) for s in sets], percent)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert near[i, j] or 100 * both < percent * (len(a) + len(b) - both)
        assert n < 200 or not near[0, 1]  # and do part unrelated ones


def test_sets_are_made_for_near_documents_only(spark, monkeypatch):
    """Documents that share one rare phrase and nothing else: no set of theirs is written."""
    r = random.Random(9)
    text = lambda n: [f"w{r.random()}" for _ in range(n)]
    rows = [(i, " ".join(text(150) + ["one", "shared", "phrase"] + text(150))) for i in range(40)]
    near = text(300)
    rows += [(100, " ".join(near)), (101, " ".join([*near[:299], "other"]))]
    made = {}

    def watched(df, name, plain=nd.stored):
        out = plain(df, name)
        made.setdefault(name, []).extend(r.doc for r in out.select("doc").collect()) if "doc" in df.columns else None
        return out

    monkeypatch.setattr(nd, "stored", watched)
    monkeypatch.setattr(nd, "index_keys", lambda shingles, freq, percent: shingles)  # every shared shingle is a key
    got = components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(made["jaccard-groups"]) == {i for i, _ in rows} and set(made["jaccard-shingles"]) == {100, 101}
    assert {d for d, c in got.items() if c != d} == {101}
