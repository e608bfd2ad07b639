"""Long tracks split on hulls: the same cuts as without, in few rounds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seawake.operators import hulls, simplify
from seawake.schema import POINT_SCHEMA


def track(spark, n, lon, lat, mmsi=200000001, step=10):
    """``n`` reports of one vessel, ``step`` seconds apart, at ``lon`` and ``lat`` (columns of ``id``)."""
    p = spark.range(n).select(
        F.lit(mmsi).cast("long").alias("mmsi"),
        F.timestamp_seconds(F.col("id") * step + 1735689600).alias("base_date_time"),
        lon.alias("longitude"), lat.alias("latitude"), F.col("id").alias("src_id"), F.lit("X").alias("vessel_name"),
    )
    for field in POINT_SCHEMA.fields:
        if field.name not in p.columns:
            p = p.withColumn(field.name, F.lit(None).cast(field.dataType))
    return p


def spiral(spark, n, turns):
    turn = F.col("id") * (2 * np.pi * turns / n)
    out = 0.2 + F.col("id") / n
    return track(spark, n, 120 + out * F.cos(turn), 30 + out * F.sin(turn))


def levels(df):
    return {(r.mmsi, r.ts): r.level for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and len(got) > 10
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got if want[k] != float("inf"))


def test_a_spiral_takes_one_round_and_gives_the_same_cuts(spark, monkeypatch):
    p = spiral(spark, 60_000, 150)
    want = levels(simplify.split_levels(p, 50))
    seen = []
    real = simplify.every_report
    monkeypatch.setattr(simplify, "every_report", lambda rows: seen.append(1) or real(rows))
    same(levels(simplify.split_levels(p, 50, stretch_rows=2000)), want)
    assert len(seen) == 1


def noisy(n):
    """A ship that swings at anchor, crosses over in a straight line, and swings again; reports repeat places."""
    rng = np.random.default_rng(3)
    i = np.arange(n)
    x = np.clip((i - n // 3) * 3 / n, 0, 1)
    return 120 + x + np.round(rng.uniform(-1e-3, 1e-3, n), 4), 30 + np.round(rng.uniform(-1e-3, 1e-3, n), 4)


def curled(n):
    turn, out = np.arange(n) * (2 * np.pi * 9 / n), 0.2 + np.arange(n) / n
    return 120 + out * np.cos(turn), 30 + out * np.sin(turn)


@pytest.mark.parametrize("shape", [noisy, curled])
@pytest.mark.parametrize("leaf_rows", [1, 4, 32])
def test_cuts_of_leaves_are_those_of_all_reports(shape, leaf_rows):
    n, floor = 6000, 20 / 111_000
    x, y = shape(n)
    ts = (np.arange(n) * 10 + 1735689600) * 1_000_000
    t = pa.table({
        "mmsi": np.full(n, 1), "stretch": np.zeros(n, np.int64), "cap": np.full(n, np.inf),
        "ts": pa.array(ts).cast(pa.timestamp("us", "UTC")), "lon": x, "lat": y,
    })
    found = simplify._levels(floor)(t)
    want = dict(zip(found["ts"].to_pylist(), found["level"].to_pylist()))
    got, todo = {}, [(ts[0], ts[-1], np.inf)]
    while todo:
        a, b, cap = todo.pop()
        part = t.filter(pa.array((ts >= a) & (ts <= b)))
        part = part.set_column(2, "cap", pa.array(np.full(len(part), cap)))
        corners = hulls._corners(leaf_rows)(part)
        pieces = hulls._descend(floor, 200)(corners)
        spans = zip(pieces["a"].cast(pa.int64()).to_pylist(), pieces["b"].cast(pa.int64()).to_pylist())
        for kind, level, at, (u, v) in zip(pieces["kind"].to_pylist(), pieces["level"].to_pylist(), pieces["a"].to_pylist(), spans):
            if kind == "cut":
                got[at] = level
            elif kind == "open":
                todo.append((u, v, level))
            else:
                piece = t.filter(pa.array((ts >= u) & (ts <= v)))
                piece = piece.set_column(2, "cap", pa.array(np.full(len(piece), level)))
                inner = simplify._levels(floor)(piece)
                got.update(zip(inner["ts"].to_pylist(), inner["level"].to_pylist()))
        assert leaf_rows > 1 or not todo
    same(got, want)


def test_a_stretch_of_too_many_corners_is_split_by_an_aggregate_first(spark):
    p = spiral(spark, 4000, 3)
    want = levels(simplify.split_levels(p, 50))
    same(levels(simplify.split_levels(p, 50, stretch_rows=500, max_corners=1500)), want)


def test_corners_hold_the_farthest_point_of_every_line():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 300):
        x, y = np.round(rng.normal(size=(2, n)), 2)
        places = hulls.hull_places(x, y)
        for ax, ay, bx, by in rng.normal(size=(50, 4)):
            d = hulls.distances(x, y, ax, ay, bx, by)
            assert d[places].max() == d.max()
    flat = np.arange(5.0)
    assert hulls.hull_places(flat, flat).tolist() == [0, 1, 2, 3, 4]
    assert hulls.hull_places(np.zeros(5), np.zeros(5)).tolist() == [0]
    assert pa.array(hulls.hull_places(flat, -flat)).type == pa.int64()


def test_a_noisy_stretch_too_long_for_a_task_goes_by_leaves(spark):
    swing = lambda s: F.round((F.xxhash64("id", F.lit(s)) % 1000) / 1e6, 4)
    p = track(spark, 3000, 120 + F.col("id") / 3000 + swing(1), 30 + swing(2))
    want = levels(simplify.split_levels(p, 20))
    same(levels(simplify.split_levels(p, 20, stretch_rows=800, max_corners=2900)), want)
