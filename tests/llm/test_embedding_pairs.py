"""The epsilon grid order join against all pairs."""

import collections
import math

import numpy as np
import pytest

from seawake.llm import embedding_pairs as ep

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, limit, kind=np.float32):
    """Per row (n_links, component), by comparing all pairs in double precision."""
    unit = []
    for key, v in rows:
        ok = key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, kind).astype(float) if ok else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    top = {key: key for key, _ in rows if key is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for i, x in enumerate(unit):
        for j, y in enumerate(unit):
            if i < j and x is not None and y is not None and len(x) == len(y) and float(x @ y) >= limit:
                links[i] += 1
                links[j] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                top[max(a, b)] = min(a, b)
    return collections.Counter((key, n, None if key is None else find(key)) for (key, _), n in zip(rows, links))


def clustered(seed, n, dims, groups):
    """Random directions and groups around some of them, of very different sizes, with equal ones."""
    r = np.random.default_rng(seed)
    rows = [r.normal(size=dims) for _ in range(n)]
    for g in range(groups):
        centre = r.normal(size=dims)
        for _ in range(4 ** (g % 5)):
            rows.append((centre + r.normal(size=dims) * r.uniform(0, 0.5)) * r.uniform(0.1, 10))
        rows += [rows[-1]] * (g % 3)
    order = r.permutation(len(rows))
    return [(int(i) * 3 + 1, [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]


def found(spark, rows, limit=0.9, schema=SCHEMA):
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], schema)
    got = ep.embedding_components(df, limit).collect()
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in got)
    return collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got)


@pytest.mark.parametrize("dims, limit", [(3, 0.99), (16, 0.9), (40, 0.8)])
def test_all_pairs(spark, monkeypatch, dims, limit):
    monkeypatch.setattr(ep, "INTERVAL_BYTES", 60 * 4 * dims)
    monkeypatch.setattr(ep, "LEAST_ROWS", 16)
    monkeypatch.setattr(ep, "FANOUT", 3)
    rows = clustered(dims, 300, dims, 10)
    assert found(spark, rows, limit) == brute(rows, limit)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1e30, 1e30]), (8, [1e-30, 1e-30]), (9, [1.0, 1.0]), (10, [1.0, 1.0]), (10, [1.0, 1.0]),
        (None, [1.0, 1.0]), (None, None), (11, [1.0, 1.0, 0.0]), (12, [1.0, 1.0, 0.0]), (13, [-1.0, -1.0]),
        (14, [0.0, 1.0]), (14, [1.0, 0.0]), (15, [0.0, 2.0]), (16, [3.0, 0.0]), (17, [1.0, 0.5]), (18, [-0.0, 7.0]),
    ]
    assert found(spark, rows) == brute(rows, 0.9)
    assert found(spark, []) == collections.Counter()
    assert found(spark, [(1, None)]) == collections.Counter([(1, 0, 1)])


def test_borders_and_doubles(spark):
    """Cosines on the limit and just beside it are decided in double precision."""
    turns = [math.acos(0.9) + e for e in (-1e-7, -1e-12, 1e-12, 1e-7)]
    rows = [(i, [math.cos(t), math.sin(t)]) for i, t in enumerate([0.0, *turns])]
    got = found(spark, rows, schema="vec_id long, embedding array<double>, label int")
    assert got == brute(rows, 0.9, float)


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.01], 2, "b")], "vec_id int, embedding array<float>, print int, rep string")
    assert {tuple(r) for r in ep.embedding_components(df).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


def test_distant_intervals_are_skipped(spark):
    """On separate groups the recursion leaves few pairs of intervals."""
    boxes = [(i, 2, [float(i), 0.0], [i + 0.5, 0.1]) for i in range(200)]
    df = spark.createDataFrame(boxes, "node long, d int, lo array<double>, hi array<double>")
    got = {tuple(r) for r in ep.close_intervals(df, 200, 0.6).collect()}
    assert got == {(i, i) for i in range(200)} | {(i, i + 1) for i in range(199)}
