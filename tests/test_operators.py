"""Hand-made cases and invariants per operator."""

import math

import numpy as np
import pytest
from conftest import SF, at
from pyspark.sql import functions as F

from checks.base import END, START, pairs, ports, zones
from seawake.functions.geo import bearing_deg, hav_m, point_in_ring
from seawake.operators import density, events, forecast, heading, proximity, retrieval, samples, similarity, simplify, trips
from seawake.operators import zones as zone_ops
from seawake.plans.checkpoints import reliable_checkpoint


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gap_edges(make_points):
    p = make_points([(200000001, t, 121.0 + t / 1e5, 30.0) for t in (0, 3600, 7201)])
    assert rows(trips.build_trips(p), F.unix_seconds("ts") % 86400, "seq_id") == [(0, 1), (3600, 1), (7201, 2)]
    assert trips.segment_points(p).agg(F.max("segment_id")).first()[0] == 3
    half = make_points([(200000001, t, 121.0, 30.0) for t in (0, 1800, 3601)])
    assert trips.segment_points(half).agg(F.max("segment_id")).first()[0] == 2
    assert trips.build_segments(half).count() == 1


def test_same_time_keeps_smallest_source(make_points):
    p = make_points([(200000001, 0, 121.0, 30.0), (200000001, 0, 122.0, 30.0), (200000001, 60, 121.1, 30.0)])
    assert rows(trips.build_trips(p), "lon") == [(121.0,), (121.1,)]


def test_statistics_of_one_report(make_points):
    s = trips.track_statistics(make_points([(200000001, 0, 121.0, 30.0)])).first()
    assert (s["distance_km"], s["duration_h"], s["max_speed_kn"], s["avg_speed_kn"]) == (0, 0, 0, 0)


def test_period_is_interpolated(make_points):
    p = make_points([(200000001, 0, 121.0, 30.0), (200000001, 1000, 122.0, 31.0)])
    t = trips.build_trips(p)
    cut = trips.at_period(t, at(250), at(500))
    assert rows(cut, F.round("lon", 6), F.round("lat", 6)) == [(121.25, 30.25), (121.5, 30.5)]
    whole = trips.track_statistics(p).first()["distance_km"]
    part = trips.track_statistics(p, at(250), at(500)).first()
    assert part["distance_km"] == pytest.approx(whole / 4)
    assert part["duration_h"] == pytest.approx(250 / 3600)


def test_leg_lengths_add_up(fixture_points):
    total = trips.legs(trips.build_trips(fixture_points)).groupBy("mmsi").agg((F.sum("dist_m") / 1000).alias("km"))
    both = total.join(trips.track_statistics(fixture_points), "mmsi")
    assert both.where(F.abs(F.col("km") - F.col("distance_km")) > 1e-6).isEmpty()


def test_point_on_boundary_is_outside(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))])
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (2.0, 2.0), (1.0, 0.0), (3.0, 1.0), (None, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(point_in_ring("x", "y", ring)).collect()] == [True, False, False, False, False, False]


def test_zone_with_hole_and_crossing_between_reports(spark, make_points):
    from seawake.sources.zones import zones_from_geojson

    outer = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]
    z = zones_from_geojson([{"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [outer, hole]}], spark)
    assert rows(z, "zone_id", "name") == [(2, "禁区2")]
    p = make_points([(200000001, 0, 2.0, 2.0), (200000002, 0, 0.5, 2.0), (200000003, 0, -1.0, 2.0), (200000003, 600, 5.0, 2.0)])
    assert rows(zone_ops.zone_entries(p, z), "mmsi") == [(200000002,)]
    got = zone_ops.area_detection(p, z, at(0), at(3600))
    assert rows(got, "mmsi", "n_inside") == [(200000002, 1), (200000003, 0)]
    assert got.where("mmsi = 200000003").first()["enter_time"] is None


def test_port_entries_and_exits_balance(spark, fixture_points):
    stays = zone_ops._vessel_stays(fixture_points, ports(spark), START, END)
    assert stays.where("entries - exits not in (0, 1)").isEmpty()
    listed = zone_ops.port_stays(fixture_points, ports(spark), START, END).groupBy("port_id", "mmsi").agg(F.sum("stay_minutes").alias("m"))
    both = listed.join(stays, ["port_id", "mmsi"])
    assert both.count() == stays.count() and both.where("abs(m - stay_minutes) > 1e-6").isEmpty()


def test_frames_hold_and_start(make_points):
    p = make_points([(200000001, 100, 121.0, 30.0, 5.0, 10.0), (200000001, 20_000, 122.0, 30.0)])
    f = trips.resample_frames(p, at(0), at(30_000), 10_000)
    assert rows(f, "frame", F.round("lon", 4), "sog") == [(1, 121.4975, 5.0), (2, 122.0, 0.0), (3, 122.0, 0.0)]


def test_trails_across_blocks(make_points):
    p = make_points([(200000001, 0, 121.0, 30.0), (200000001, 300, 122.0, 30.0)])
    f = trips.resample_frames(p, at(0), at(300), 10)
    got = trips.frame_trails(f, n=10, block=12)
    assert rows(got, "frame", F.size("trail")) == [(i, min(i, 10) + 1) for i in range(31)]


def test_displacement_round_trip(make_points):
    p = make_points([(200000001, t, 121.0 + t * t / 1e7, 30.0 - t / 1e5) for t in range(0, 3000, 100)])
    t = trips.ordered_points(p).select(F.col("mmsi").alias("track_id"), (F.unix_seconds("base_date_time") % 86400).alias("i"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    start = t.orderBy("i").limit(1)
    back = trips.from_displacement(trips.to_displacement(t), start)
    diff = back.join(t.withColumnRenamed("lon", "x").withColumnRenamed("lat", "y"), ["track_id", "i"])
    assert diff.count() == 30 and diff.where("abs(lon - x) > 1e-9 or abs(lat - y) > 1e-9").isEmpty()


def test_simplify_is_independent_of_task_size(fixture_points):
    whole = rows(simplify.split_levels(fixture_points, 50), "mmsi", "ts", F.round("level", 9))
    cut = rows(simplify.split_levels(fixture_points, 50, stretch_rows=20), "mmsi", "ts", F.round("level", 9))
    assert whole == cut
    kept = simplify.simplify(fixture_points, 100)
    original = trips.ordered_points(fixture_points).select("mmsi", F.col("base_date_time").alias("ts"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    assert kept.exceptAll(original).isEmpty()


def test_abnormal_stops_are_independent_of_task_size(fixture_points, make_points):
    drift = make_points([(200000009, 60 * i, 121.0 + 0.0004 * i, 30.0, 0.5) for i in range(300)])
    for p in (fixture_points, drift):
        cols = ("mmsi", "start_time", "end_time", "n_points", F.round("lon", 9))
        whole = rows(events.abnormal_stops(p, min_minutes=5), *cols)
        cut = rows(events.abnormal_stops(p, min_minutes=5, run_rows=25), *cols)
        assert whole == cut and whole


def test_sharp_turn_across_north(make_points):
    p = make_points([(200000001, 0, 121.0, 30.0, 10.0, 350.0), (200000001, 60, 121.01, 30.0, 10.0, 15.0), (200000001, 120, 121.02, 30.0, None, 90.0)])
    assert [(r["turn_deg"], round(r["score"], 4)) for r in events.sharp_turn_events(p).collect()] == [(25.0, 0.5333), (75.0, 1.0)]


def test_anomaly_feed_needs_two_reports(make_points):
    p = make_points([(200000001, 0, 121.0, 30.0, 35.0), (200000002, 0, 121.0, 30.0, 35.0), (200000002, 60, 121.0, 30.0, 0.0)])
    feed = events.detect_anomalies(p)
    assert rows(feed, "mmsi", "event_type", "severity") == [(200000002, "overspeed", "medium")]
    assert rows(events.anomaly_summary(feed), "mmsi", "high", "medium", "low") == [(200000002, 0, 1, 0)]


def test_fleet_search_equals_all_pairs(spark, fixture_points):
    v = fixture_points.select("mmsi").distinct()
    every = v.select(F.col("mmsi").alias("mmsi_a")).join(v.select(F.col("mmsi").alias("mmsi_b")), F.col("mmsi_a") < F.col("mmsi_b"))
    slow = proximity.cpa(fixture_points, every).where("min_distance_nm < 5")
    fast = proximity.cpa(fixture_points, max_distance_nm=5)
    cols = ("mmsi_a", "mmsi_b", F.round("min_distance_m", 6), "cpa_time")
    assert rows(slow, *cols) == rows(fast, *cols) != []


def test_close_reports_across_the_date_line_and_near_the_pole(make_points):
    p = make_points([(200000001, 0, 179.999, 10.0), (200000002, 30, -179.999, 10.0), (200000003, 0, 10.0, 89.99), (200000004, 0, -170.0, 89.99), (200000005, 0, 10.0, 89.0)])
    got = proximity.cpa(p, max_distance_nm=2)
    assert rows(got, "mmsi_a", "mmsi_b") == [(200000001, 200000002), (200000003, 200000004)]


def test_nearest_approach_of_crossing_tracks(spark, make_points):
    p = make_points([(200000001, 0, 121.0, 0.0), (200000001, 1000, 121.2, 0.0), (200000002, 0, 121.1, -0.1), (200000002, 1000, 121.1, 0.1)])
    pr = spark.createDataFrame([(200000001, 200000002)], "mmsi_a long, mmsi_b long")
    n = proximity.nearest_approach(p, pr).first()
    assert n["distance_m"] == pytest.approx(0, abs=0.01) and n["ts"].timestamp() % 86400 == pytest.approx(500, abs=0.01)
    d = proximity.distance_at(p, pr, at(0)).first()["distance_m"]
    assert d == pytest.approx(math.hypot(0.1, 0.1) * 111_195, rel=1e-3)


def test_companion_rules(make_points):
    """A silent partner keeps a stretch open, a far one closes it."""
    a = [(200000001, 600 * i, 121.0 + 0.01 * i, 30.0) for i in range(12)]
    b = [(200000002, 600 * i + 20, 121.0 + 0.01 * i, 30.01 if i != 8 else 31.0) for i in range(12) if i not in (3, 4)]
    s = proximity.companion_segments(make_points(a + b), at(0), at(86_000))
    assert rows(s, "n_points", "duration_min") == [(6, 70.0)]
    t = proximity.companion_segments(make_points(a + b), at(0), at(86_000), min_duration_min=10)
    assert rows(t, "n_points", "duration_min") == [(3, 20.0), (6, 70.0)]


def test_components_of_a_long_chain(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1002, 1001)], "mmsi_a long, mmsi_b long")
    c = {r["mmsi"]: r["component"] for r in proximity.connected_components(e).collect()}
    assert c == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert rows(proximity.companion_groups(e).select("group_id", "size", "n_pairs").distinct(), "group_id", "size", "n_pairs") == [(0, 61, 60), (1000, 3, 2)]


def test_pruned_range_query_equals_scan(spark, fixture_points):
    s = trips.trip_summary(trips.build_trips(fixture_points))
    # numbers of rows are pinned, for they depend on how the boxes are partitioned when they are made
    boxes = reliable_checkpoint(s.select(F.monotonically_increasing_id().alias("box_id"), F.col("mbb").alias("box")))
    fast, slow = retrieval.range_query(s, boxes), retrieval.range_query(s, boxes, pruned=False)
    assert fast.exceptAll(slow).isEmpty() and slow.exceptAll(fast).isEmpty() and fast.count() > 0


def test_partition_is_balanced(fixture_points):
    s = trips.trip_summary(trips.build_trips(fixture_points))
    n = [r["count"] for r in retrieval.st_partition(s, 4).groupBy("part").count().collect()]
    assert len(n) == 4 and max(n) - min(n) <= 2 and sum(n) == s.count()


def test_spline_reproduces_cubics():
    t = np.array([0, 20, 90, 130, 170, 300, 310], dtype=float)
    f = lambda x: 2 + 0.3 * x - 0.01 * x**2 + 1e-5 * x**3
    at_ = np.arange(0, 330, 7.0)
    np.testing.assert_allclose(samples.spline_values(t, f(t), at_), f(at_), rtol=1e-10, atol=1e-10)


def test_spline_blocks_equal_one_solve(make_points):
    rng = np.random.default_rng(5)
    times = np.cumsum(rng.integers(20, 200, 700))
    p = make_points([(200000001, int(t), 121 + 0.3 * math.sin(t / 9000), 30 + 0.2 * math.cos(t / 7000)) for t in times])
    v = samples.valid_segments(p)
    cols = ("k", F.round("lon", 11), F.round("lat", 11))
    one, many = samples.spline_resample(v), samples.spline_resample(v, block_knots=100)
    assert one.count() == -(-(int(times[-1] - times[0]) + 30) // 30)
    assert rows(one, *cols) == rows(many, *cols)


def test_samples_are_numbered_and_contiguous(fixture_points):
    s = samples.samples_from_points(fixture_points).orderBy("global_traj_id").collect()
    assert [r["global_traj_id"] for r in s] == list(range(len(s))) and s
    assert [(r["mmsi"], r["segment_id"], r["start_time"]) for r in s] == sorted((r["mmsi"], r["segment_id"], r["start_time"]) for r in s)
    for r in s:
        assert len(r["obs"]) == 120 and len(r["pred"]) == 360
        assert np.all(np.diff(r["obs_time"]) == 30)


def test_quantise_is_bisection():
    for value in (0.0, 0.1, 0.55, 0.55001, 0.99, 1.0, 2.0):
        low, high, bits = 0.1, 1.0, 0
        v = min(max(value, low), high)
        for _ in range(8):
            mid = (low + high) / 2
            upper = v > mid
            bits = bits * 2 + upper
            low, high = (mid, high) if upper else (low, mid)
        assert similarity.quantise(value, similarity.midpoints(0.1, 1.0)) == bits
    assert similarity.interleave([0b10000000, 0, 0b11111111, 1]) == int("1010" + "0010" * 6 + "0011", 2)


@pytest.mark.parametrize("exclude", [False, True])
def test_similar_tracks_equal_brute_force(spark, exclude):
    rng = np.random.default_rng(3)
    codes = [int(c) for c in np.concatenate([np.zeros(40), rng.integers(0, 64, 60), rng.integers(0, 2**32, 60)])]
    s = spark.createDataFrame(list(enumerate(codes)), "global_traj_id long, code long")
    q = s.select(F.col("global_traj_id").alias("query_id"), "code")
    got = {}
    for r in similarity.similar_tracks(s, q, k=4, exclude_self=exclude).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["global_traj_id"])
    for i, c in enumerate(codes):
        order = sorted((c ^ d, j) for j, d in enumerate(codes) if not (exclude and i == j))
        assert got[i] == [j for _, j in order[:4]]


def test_retrieval_forecast_fallbacks(spark):
    track = lambda x0, dx: [(30.0, x0 + dx * i) for i in range(3)]
    schema = "global_traj_id long, obs array<struct<lat:float,lon:float>>, pred array<struct<lat:float,lon:float>>"
    s = spark.createDataFrame([(1, track(121.0, 0.5), track(122.5, 0.5))], schema)
    q = spark.createDataFrame([(7, track(100.0, 1.0)), (8, track(110.0, 1.0))], "query_id long, obs array<struct<lat:float,lon:float>>")
    near = spark.createDataFrame([(7, 1, 1)], "query_id long, rank int, global_traj_id long")
    f = forecast.forecast_retrieval(s, q, near, k=2)
    got = rows(f, "query_id", "step", F.round("lon", 4), F.round("confidence", 2))
    assert got == [(7, 1, 102.5, 0.5), (7, 2, 103.0, 0.5), (7, 3, 103.5, 0.5), (8, 1, 112.0, 0.1), (8, 2, 113.0, 0.1), (8, 3, 114.0, 0.1)]


def test_linear_forecast_goes_straight(make_points):
    p = make_points([(200000001, 60 * i, 121.0 + 0.01 * i, 30.0 + 0.02 * i) for i in range(15)] + [(200000002, 0, 1.0, 1.0)])
    f = forecast.forecast_linear(p, 10, 5)
    assert rows(f, "mmsi", "step", F.round("lon", 6), F.round("lat", 6)) == [(200000001, 1, 121.19, 30.38), (200000001, 2, 121.24, 30.48)]


def test_heading_falls_back_to_course(make_points):
    p = make_points([(200000001, 60 * i, 121.0, 30.0, 1.0, 90.0 + i) for i in range(3)])
    assert rows(heading.heading_series(p), "heading", "turn_rate") == [(90.0, None), (91.0, 1.0), (92.0, 1.0)]


def test_distances_and_bearings(spark):
    df = spark.range(1).select(
        hav_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"),
        bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)).alias("west"),
        bearing_deg(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("none"),
    )
    r = df.first()
    assert r["d"] == pytest.approx(6_371_000 * math.pi / 180) and r["west"] == pytest.approx(270) and r["none"] is None


def test_arguments_are_checked(fixture_points):
    with pytest.raises(ValueError):
        trips.track_statistics(fixture_points, at(10), at(10))
    with pytest.raises(ValueError):
        trips.build_trips(fixture_points, mmsi=5)
    with pytest.raises(ValueError):
        density.viewport_heatmap(fixture_points, (1.0, 1.0, 1.0, 2.0))


def test_pairs_cover_the_fleet(spark):
    assert pairs(spark, SF).count() >= 0 and zones(spark).count() == 2


def test_references_are_cut_or_filled(spark):
    step = lambda n: [(1.0, 2.0)] * n
    df = spark.createDataFrame([(1, step(2)), (2, step(5))], "id long, disp array<struct<d_lon:double,d_lat:double>>")
    got = {r["id"]: [tuple(d) for d in r["disp"]] for r in forecast.align_reference(df, 3).collect()}
    assert got == {1: [(1.0, 2.0), (1.0, 2.0), (0.0, 0.0)], 2: step(3)}
