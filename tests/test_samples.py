"""Frames, windows, numbers and forecasts move reports or whole tracks, not single grid points."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seawake.operators import forecast, samples, trips
from seawake.plans.groups import whole_groups
from tests.conftest import at


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_made_after_the_last_shuffle(make_points):
    p = make_points([(1, 100, 1.0, 2.0), (1, 400, 2.0, 2.0), (2, -50, 0.0, 0.0), (2, 7000, 7.0, 0.0)])
    f = trips.resample_frames(p, at(0), at(600), 60, nth=True)
    text = plan(f)
    assert "Exchange" in text and text.index("Generate") < text.index("Exchange")
    got = sorted((r.mmsi, r.frame, r.nth, round(r.lon, 6)) for r in f.collect())
    one = [(1, i, i - 2, round(1 + (60 * i - 100) / 300, 6) if 60 * i < 400 else 2.0) for i in range(2, 11)]
    assert got == one + [(2, i, i, round(7 * (60 * i + 50) / 7050, 6)) for i in range(11)]


@pytest.mark.parametrize("lengths", [(2, 1, 1), (4, 2, 3), (5, 3, 2)])
def test_windows_across_chunks(spark, monkeypatch, lengths):
    obs, pred, stride = lengths
    monkeypatch.setattr(samples, "CHUNK_WINDOWS", 2)
    rows = [(m, 1, k, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=30 * k), float(k), float(m)) for m in (1, 2) for k in range(40 + m) if (m, k) != (2, 17)]
    grid = spark.createDataFrame(rows, "mmsi long, segment_id long, k long, ts timestamp, lon double, lat double").repartition(5)
    s = samples.sliding_samples(grid, obs, pred, stride)
    got = sorted((r.mmsi, [int(p.lon) for p in r.obs], [int(p.lon) for p in r.pred], len(r.obs_time)) for r in s.collect())
    has = {(r[0], r[2]) for r in rows}
    want = []
    for m in (1, 2):
        for first in range(0, 42, stride):
            ks = list(range(first, first + obs + pred))
            if all((m, k) in has for k in ks):
                want.append((m, ks[:obs], ks[obs:], obs))
    assert got == want and len(got) > 8
    assert "ObjectHashAggregate" not in plan(s)


def test_numbers_read_the_samples_once_more(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(m, g, day + dt.timedelta(hours=17 * g + 5 * i)) for m in (100_001, 7, 300_000) for g in (1, 2, 10) for i in range(4)]
    s = spark.createDataFrame(rows, "mmsi long, segment_id long, start_time timestamp").repartition(3)
    n = samples.with_global_id(s)
    assert plan(n).count("RoundRobinPartitioning") == 1
    got = sorted((r.global_traj_id, r.mmsi, r.segment_id, r.start_time) for r in n.collect())
    assert [g[1:] for g in got] == sorted(rows) and [g[0] for g in got] == list(range(len(rows)))


def test_filtered_grid_is_not_ordered(spark):
    rows = [(m, 1, k, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=30 * k), 0.0, (0.1 if m == 2 and k == 3 else 0.0)) for m in (1, 2) for k in range(6)]
    grid = spark.createDataFrame(rows, "mmsi long, segment_id long, k long, ts timestamp, lon double, lat double")
    kept = samples.filter_resampled(grid)
    assert {r.mmsi for r in kept.collect()} == {1} and kept.count() == 6
    assert "Window" not in plan(kept) and "Sort" not in plan(kept)


def test_groups_of_a_stream():
    keys = np.repeat([1, 2, 3, 5, 6], [3, 10, 1, 1, 4])
    for size in (1, 2, 3, 4, 7, 19, 30):
        table = pa.table({"a": keys, "n": np.arange(len(keys))})
        found = []
        for t, borders in whole_groups(table.to_batches(max_chunksize=size), ["a"]):
            found += [t["n"].to_pylist()[lo:hi] for lo, hi in zip(borders[:-1], borders[1:])]
        assert found == [np.flatnonzero(keys == k).tolist() for k in (1, 2, 3, 5, 6)]
    assert not list(whole_groups([], ["a"]))


def test_forecast_moves_tracks(spark):
    track = "array<struct<lat: float, lon: float>>"
    line = lambda x, dx, n: [(0.0, float(x + dx * i)) for i in range(n)]
    s = spark.createDataFrame(
        [(1, line(0, 1, 3), line(3, 1, 4)), (2, line(5, 3, 3), line(14, 3, 2)), (3, line(0, 0.5, 3), [])],
        f"global_traj_id long, obs {track}, pred {track}",
    )
    asked = s.select(F.col("global_traj_id").alias("query_id"), "obs")
    near = spark.createDataFrame([(3, 1, 1), (3, 2, 2)], "query_id long, rank int, global_traj_id long")
    f = forecast.forecast_retrieval(s, asked, near, k=3)
    text = plan(f)
    assert "Window" not in text and "Generate" not in text
    got = {q: [(r.step, round(r.lon, 5)) for r in sorted(f.where(F.col("query_id") == q).collect())] for q in (1, 2, 3)}
    # steps of 1 (once) and 3 (twice) from 1.0, then of 1 alone
    assert got[3] == [(1, round(1 + 7 / 3, 5)), (2, round(1 + 14 / 3, 5)), (3, round(2 + 14 / 3, 5)), (4, round(3 + 14 / 3, 5))]
    assert got[1] == [(1, 2.0), (2, 3.0), (3, 4.0)]  # its own movement: none, then 1 and 1
    steps = spark.createDataFrame([(q, n, x, 0.0) for q in got for n, x in got[q]], "query_id long, step int, lon double, lat double")
    errors = forecast.forecast_errors(steps, steps.withColumn("lon", F.col("lon") + F.col("step")))
    assert plan(errors).count("Exchange") == 1 and "SortAggregate" not in plan(errors)
    assert {r.query_id: (r.ade_deg, r.fde_deg) for r in errors.collect()} == {1: (2.0, 3.0), 2: (2.0, 3.0), 3: (2.5, 4.0)}
