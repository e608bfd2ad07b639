"""Searches on space-time cells against brute force, and what their plans do."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from seawake.functions.geo import point_in_edges, ring_edges
from seawake.operators import retrieval, zones
from seawake.plans import cells, joins
from seawake.sources.zones import ring_box

DAY = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
BOX = "struct<xmin:double,xmax:double,ymin:double,ymax:double,tmin:timestamp,tmax:timestamp>"


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def boxes_of(seed, n, most_deg, most_s):
    """Boxes of all sizes, points and instants among them, some on cell borders."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = (round(r.uniform(-180, 170) * 16) / 16, 0.0) if i % 7 == 0 else (r.gauss(120, 3), r.gauss(30, 3))
        w, h = (r.choice([0, 0.0001, 0.0625, 1, r.random() * most_deg]) for _ in "xy")
        t = r.uniform(0, 40 * 86400) if i % 5 else 86400.0 * r.randint(0, 40)
        out.append((i, (x, x + w, y, y + h, t, t + r.choice([0, 1, 86400, r.random() * most_s]))))
    return out


def frame(spark, rows, name):
    return spark.createDataFrame([(i, (*b[:4], at(b[4]), at(b[5]))) for i, b in rows], f"{name} long, b {BOX}")


@pytest.fixture(params=["broadcast", "salted"])
def join_kind(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    return request.param


def test_boxes_of_all_sizes_meet(spark, join_kind):
    trips, asked = boxes_of(1, 400, 30, 30 * 86400), boxes_of(2, 150, 300, 200 * 86400)
    s = frame(spark, trips, "mmsi").withColumnRenamed("b", "mbb")
    q = frame(spark, asked, "box_id").withColumnRenamed("b", "box")
    want = {
        (i, j) for i, a in asked for j, b in trips
        if all(a[k] <= b[k + 1] and b[k] <= a[k + 1] for k in (0, 2, 4))
    }
    assert {tuple(r) for r in retrieval.range_query(s, q).collect()} == want
    if join_kind == "broadcast":
        assert {tuple(r) for r in retrieval.range_query(s, q, pruned=False).collect()} == want
        empty = q.limit(0)
        assert not retrieval.range_query(s, empty).collect() and not retrieval.range_query(s, empty, pruned=False).collect()


def test_each_box_has_few_cells(spark):
    leveled = cells.with_levels(frame(spark, boxes_of(3, 500, 400, 900 * 86400), "id"), "b")
    found = cells.covered(leveled, "b", [(0, 0)], True).groupBy("id").agg(F.count("*").alias("n"))
    assert found.agg(F.max("n")).first()[0] <= 8 and found.count() == 500


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_product(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    s = frame(spark, boxes_of(1, 50, 1, 86400), "mmsi").withColumnRenamed("b", "mbb")
    q = spark.createDataFrame([(i, 120.0 + i, 30.0, at(3600 * i)) for i in range(30)], "query_id long, lon double, lat double, ts timestamp")
    near = plan_of(retrieval._around(s, q, 0.1, 2))
    meet = plan_of(cells.cell_join(s, "mbb", retrieval._ring(q, 1.0), "box"))
    for plan in (near, meet):
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert all(key in plan for key in ("_x#", "_y#", "_t#"))
    many = [(i, (120.0, 121.0, 30.0, 31.0, 0.0, 60.0)) for i in range(2500)]
    few, lots = (retrieval._scan(s, frame(spark, many[:n], "box_id").withColumnRenamed("b", "box")) for n in (1, 2500))
    assert plan_of(few).count("\n") == plan_of(lots).count("\n")


def test_thousand_queries(spark, join_kind):
    r = random.Random(4)
    trips = [
        (i // 2, (x, x + w, y, y + h, t, t + r.uniform(0, 20_000)))
        for i in range(900)
        for x, y, w, h, t in [(r.gauss(120, 4), r.gauss(30, 2), r.random() ** 4, r.random() ** 4, r.uniform(0, 86400))]
    ]
    s = frame(spark, trips, "mmsi").withColumnRenamed("b", "mbb")
    n = 1000 if join_kind == "broadcast" else 60
    asked = [(i, r.gauss(120, 5) if i % 50 else 10.0, r.gauss(30, 3), r.uniform(-4000, 90_000)) for i in range(n)]
    q = spark.createDataFrame([(i, x, y, at(t)) for i, x, y, t in asked], "query_id long, lon double, lat double, ts timestamp")
    k = 5
    want = {}
    for i, x, y, t in asked:
        t = (at(t) - DAY).total_seconds()
        best = {}
        for v, (x0, x1, y0, y1, t0, t1) in trips:
            t0, t1 = ((at(z) - DAY).total_seconds() for z in (t0, t1))
            if t0 <= t + 3600 and t1 >= t - 3600:
                dx, dy, gap = max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1), max(t0 - t, 0, t - t1) / 3600
                level = next((m for m in range(11) if max(dx, dy) <= 0.1 * 2**m), None)
                if level is not None:
                    old = best.get(v, (99, math.inf))
                    best[v] = (min(level, old[0]), min(math.sqrt(dx * dx + dy * dy + gap * gap), old[1]))
        held = sorted(m for m, _ in best.values())
        stop = held[k - 1] if len(held) >= k else 10
        near = sorted((d, v) for v, (m, d) in best.items() if m <= stop)[:k]
        want |= {(i, rank, v): d for rank, (d, v) in enumerate(near, 1)}
    got = {(g.query_id, g["rank"], g.mmsi): g.distance for g in retrieval.knn_query(s, q, k=k).collect()}
    assert got == pytest.approx(want, abs=1e-7)


def polygons(seed):
    """Stars, slivers and boxes from 50 m to 40 degrees, on cell borders too."""
    r = random.Random(seed)
    out = []
    for i in range(24):
        size, n = 10 ** r.uniform(-3, 1.6), r.choice([3, 4, 7, 40])
        x, y = r.uniform(-60, 60), r.uniform(-30, 30)
        turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(x + size * (s := r.uniform(0.1, 1)) * math.cos(a), y + size * s * math.sin(a)) for a in turns]
        if i % 6 == 0:
            x, y = round(x), round(y)
            ring = [(x, y), (x + 1, y), (x + 1, y + 0.25), (x, y + 0.25)]
        out.append((i, f"zone {i}", [(float(a), float(b)) for a, b in [*ring, ring[0]]]))
    return out


def zone_frame(spark, seed=5):
    z = spark.createDataFrame(polygons(seed), "zone_id int, name string, ring array<struct<x:double,y:double>>")
    return z.select("zone_id", "name", ring_edges(F.col("ring")).alias("edges")).withColumn("box", ring_box(F.col("edges")))


def test_cover_changes_no_answer(spark, join_kind):
    r = random.Random(6)
    spots = []
    for _, _, ring in polygons(5):
        xs, ys = zip(*ring)
        spots += [(r.uniform(min(xs), max(xs)), r.uniform(min(ys), max(ys))) for _ in range(60)]
        spots += [*ring, ((xs[0] + xs[1]) / 2, (ys[0] + ys[1]) / 2), (math.floor(xs[0]) + 0.0, math.floor(ys[0]) + 0.0)]
    p = spark.createDataFrame([(i, *s) for i, s in enumerate([*spots, (None, 1.0), (1.0, None)])], "id long, longitude double, latitude double")
    z = zone_frame(spark)
    every = p.join(F.broadcast(z)).where(point_in_edges("longitude", "latitude", "edges", F.col("box")))
    cols = ("id", "zone_id", "name")
    got, want = (sorted(tuple(x) for x in d.select(*cols).collect()) for d in (zones.points_in_zones(p, z), every))
    assert got == want and len(want) > 300


def test_inner_cells_need_no_ring(spark):
    """Large zones are mostly inner cells, there are few cells a zone, and keys have two axes."""
    n = zones._numbered(zone_frame(spark))
    c = zones.zone_cells(n)
    assert c.groupBy("zone").count().agg(F.max("count")).first()[0] <= 33 * 33
    square = n.where("zone_id = 0")
    assert zones.zone_cells(square).where("inner").count() >= 4
    p = spark.createDataFrame([(1.0, 2.0)], "longitude double, latitude double")
    plan = plan_of(zones._near_zones(p, n, "longitude", "latitude"))
    assert all(key in plan for key in ("_level#", "_x#", "_y#")) and "NestedLoop" not in plan


def test_broadcast_is_bounded_by_bytes(spark):
    small = spark.range(10).withColumn("s", F.lit("x"))
    assert joins.fits_broadcast(small) and not joins.fits_broadcast(small.withColumn("s", F.repeat(F.lit("x"), 4 << 20)))
    lists = small.withColumn("l", F.sequence(F.lit(0), F.lit(500_000)))
    assert not joins.fits_broadcast(lists) and not joins.fits_broadcast(spark.range(300_000))
