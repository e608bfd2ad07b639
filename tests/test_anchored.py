"""Anchored stops of long runs against the plain greedy walk."""

import datetime as dt
import random

import numpy as np
import pytest

from seawake.operators import anchored

DAY = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "mmsi long, run long, ts timestamp, lon double, lat double"


def greedy(rows, radius):
    """(start, end, number) of stops of one run, one report after the other."""
    out, i = [], 0
    lon, lat = np.radians([r[3] for r in rows]), np.radians([r[4] for r in rows])
    while i < len(rows):
        j = i + 1
        while j < len(rows) and anchored._distance(lon[i], lat[i], lon[j], lat[j]) <= radius:
            j += 1
        if j - i > 1:
            x, y = (sum(r[k] for r in rows[i:j]) / (j - i) for k in (3, 4))
            out.append((rows[i][0], rows[i][2], rows[j - 1][2], round(x, 8), round(y, 8), j - i))
        i = j
    return out


def walk(mmsi, seed, n, step, every=30, lon=121.0, lat=30.0):
    """A drift with pauses, returns and jumps."""
    r = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += every if r.random() < 0.99 else every * 100
        if r.random() > 0.3:
            lon, lat = lon + r.gauss(0, step), lat + r.gauss(0, step)
        if lon > 180:
            lon -= 360
        rows.append((mmsi, 1, DAY + dt.timedelta(seconds=t), lon, lat))
    return rows


def stops(spark, rows, radius, block):
    got = anchored.anchored_stops(spark.createDataFrame(rows, SCHEMA), radius, block).collect()
    return sorted((r.mmsi, r.start_time, r.end_time, round(r.lon, 8), round(r.lat, 8), r.n_points) for r in got)


def plain(rows, radius):
    by = {}
    for r in rows:
        by.setdefault(r[:2], []).append(r)
    out = [s for run in by.values() for s in greedy(run, radius)]
    return sorted((m, a.replace(tzinfo=None), b.replace(tzinfo=None), x, y, n) for m, a, b, x, y, n in out)


def same(got, want):
    clean = sorted((m, a.replace(tzinfo=None), b.replace(tzinfo=None), x, y, n) for m, a, b, x, y, n in got)
    assert [c[:3] + c[5:] for c in clean] == [w[:3] + w[5:] for w in want]
    assert [c[3:5] for c in clean] == [pytest.approx(w[3:5], abs=1e-7) for w in want]


def test_first_exit():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100, 777):
        lon, lat = np.cumsum(r.normal(0, 0.002, n)) + 179.99, np.cumsum(r.normal(0, 0.002, n)) + 80
        e = anchored.Exits(lon, lat, 500.0)
        got = e.first(np.arange(1, n + 1), e.lon, e.lat)
        for i in range(n):
            beyond = np.flatnonzero(anchored._distance(e.lon[i], e.lat[i], e.lon[i + 1 :], e.lat[i + 1 :]) > 500)
            assert got[i] == (i + 1 + beyond[0] if len(beyond) else n)


@pytest.mark.parametrize("block", [7, 200])
def test_blocks_change_nothing(spark, block):
    anchor = [(3, 1, DAY + dt.timedelta(seconds=20 * i), 5.0 + 1e-5 * (i % 7), 50.0) for i in range(900)]
    jumps = [(4, 1, DAY + dt.timedelta(seconds=3600 * i), float(i % 2), 0.0) for i in range(60)]
    rows = walk(1, 1, 900, 0.0006, every=200) + walk(2, 2, 700, 0.003, lon=179.995, lat=-60.0, every=700) + anchor + jumps
    rows += [(1, 2, DAY, 1.0, 1.0), (1, 2, DAY + dt.timedelta(hours=1), 1.0, 1.0), (9, 1, DAY, 0.0, 90.0)]
    same(stops(spark, rows, 500.0, block), plain(rows, 500.0))


def test_many_stops_take_few_rounds(spark, monkeypatch):
    """10 000 stops of one run: the number of checkpoints does not follow the number of stops."""
    rows = [(1, 1, DAY + dt.timedelta(seconds=60 * i), 0.01 * (i // 3 % 17000), 10.0) for i in range(30_000)]
    rounds = []
    keep = anchored.reliable_checkpoint
    monkeypatch.setattr(anchored, "reliable_checkpoint", lambda df: rounds.append(1) or keep(df))
    got = stops(spark, rows, 500.0, 1000)
    assert len(got) == 10_000 and {g[5] for g in got} == {3}
    assert len(rounds) <= 30 and (len(rounds) - 8) / 2 < 20
