"""Cases that once lost rows in silence, and plans that once read too much."""

import datetime as dt

import pytest
from conftest import at
from pyspark.sql import functions as F

from seawake.operators import density, events, heading, proximity, retrieval, samples, trips
from seawake.plans.joins import sized_broadcast


def test_overspeed_settles_copies_first(make_points):
    """Of two reports of one instant the first stays, slow or fast."""
    p = make_points([(1, 0, 121.0, 30.0, 5.0), (1, 0, 121.0, 30.0, 45.0), (2, 0, 121.0, 30.0, 45.0), (2, 0, 121.0, 30.0, 5.0)])
    assert [r.mmsi for r in events.overspeed_events(p, 30.0).collect()] == [2]


def test_frame_trails_longer_than_a_block(make_points):
    p = make_points([(1, 60 * i, 121 + i / 100, 30.0) for i in range(40)])
    frames = trips.resample_frames(p, at(0), at(60 * 39), 60)
    got = trips.frame_trails(frames, n=25, block=10).collect()
    assert {r.frame: len(r.trail) for r in got} == {i: min(i, 25) + 1 for i in range(40)}


def test_filter_resampled_with_another_step(spark):
    rows = [(1, 1, at(60 * i), 121.0 + i, 30.0) for i in range(5)] + [(2, 1, at(60 * i), 121.0 + i / 1e4, 30.0) for i in range(5)]
    df = spark.createDataFrame(rows, "mmsi long, segment_id long, ts timestamp, lon double, lat double")
    kept = samples.filter_resampled(df, step_s=60)
    assert {r.mmsi for r in kept.collect()} == {2}


@pytest.fixture(scope="module")
def summaries(spark):
    rows = [(i, i % 17 / 3, i % 13 / 2, i) for i in range(400)]
    df = spark.createDataFrame(rows, "mmsi long, x double, y double, s int")
    t = F.timestamp_seconds(F.col("s") * 60)
    return df.select("mmsi", F.struct(
        F.col("x").alias("xmin"), (F.col("x") + 0.5).alias("xmax"), F.col("y").alias("ymin"), (F.col("y") + 0.5).alias("ymax"),
        t.alias("tmin"), (t + F.expr("interval 1 hour")).alias("tmax"),
    ).alias("mbb"))


def test_more_boxes_than_a_block(summaries, spark):
    boxes = summaries.limit(30).crossJoin(spark.range(40)).select(
        (F.col("mmsi") * 40 + F.col("id")).alias("box_id"), F.col("mbb").alias("box")
    )
    pruned, scanned = (retrieval.range_query(summaries, boxes, pruned=p) for p in (True, False))
    assert scanned.count() == pruned.count() > 1200
    assert scanned.exceptAll(pruned).isEmpty()
    assert retrieval.range_query(summaries, boxes.limit(0), pruned=False).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 10, 16])
def test_exact_number_of_parts(summaries, n):
    sizes = [r["count"] for r in retrieval.st_partition(summaries, n).groupBy("part").count().collect()]
    assert len(sizes) == n and sum(sizes) == 400
    assert max(sizes) <= 4 * min(sizes)


def test_parts_that_cannot_be_split(summaries):
    same = summaries.where("mmsi = 5").unionAll(summaries.where("mmsi = 5")).unionAll(summaries.where("mmsi = 6"))
    assert retrieval.st_partition(same, 9).select("part").distinct().count() == 2


def test_top_none_is_everything(fixture_points):
    box = (120.7, 30.2, 123.3, 31.6)
    for op, args in ((density.viewport_heatmap, (box,)), (density.vessel_density, (box,)), (density.space_time_density, ()),
                     (density.corridors, (0.005, 1)), (density.speed_grid, ()), (heading.heading_grid, ())):
        every = op(fixture_points, *args, top=None).count()
        assert every >= op(fixture_points, *args, top=1).count() == min(1, every)


def test_weights_count_one_at_least(spark):
    df = spark.range(50).withColumn("w", F.lit(-1))
    for w in (F.col("w"), F.lit(None).cast("int")):
        plan = sized_broadcast(df, weight=w, limit=49)._jdf.queryExecution().analyzed().toString()
        assert "ResolvedHint" not in plan


def test_date_line(make_points, spark):
    """A ship crosses 180 degrees; halfway it is at the line, not on the other side of the earth."""
    p = make_points([(1, 0, 179.9, 10.0), (1, 600, -179.9, 10.0), (2, 0, 179.9, 10.0), (2, 600, 179.9, 10.0)])
    flat = trips.build_trips(p, by_name=False, numbered=False)
    q = spark.createDataFrame([(1, at(150)), (1, at(450))], "mmsi long, ts timestamp")
    lons = [r.lon for r in trips.value_at(flat, q).orderBy("ts").collect()]
    assert lons == pytest.approx([179.95, -179.95])
    cut = [r.lon for r in trips.at_period(flat.where("mmsi = 1"), at(150), at(450)).orderBy("ts").collect()]
    assert cut == pytest.approx([179.95, -179.95])
    pairs = spark.createDataFrame([(1, 2)], "mmsi_a long, mmsi_b long")
    assert proximity.distance_at(p, pairs, at(300)).first().distance_m == pytest.approx(10951, rel=0.01)


@pytest.fixture(scope="module")
def table(fixture_points, tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("points"))
    fixture_points.withColumn("event_date", F.to_date("base_date_time")).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


START, END = (dt.datetime(2025, 1, 1, 4, m, tzinfo=dt.timezone.utc) for m in (0, 10))


def windowed(points, pairs):
    yield "track_statistics", trips.track_statistics(points, START, END)
    yield "speed_series", trips.speed_series(points, START, END)
    yield "track_lines", trips.track_lines(points, START, END)
    yield "heading_analysis", heading.heading_analysis(points, START, END)
    yield "heading_grid", heading.heading_grid(points, start=START, end=END)
    yield "corridors", density.corridors(points, start=START, end=END)
    yield "distance_at", proximity.distance_at(points, pairs, START)
    yield "relative_bearing", proximity.relative_bearing(points, pairs, START, END)


def test_periods_reach_the_scan(table, spark):
    pairs = spark.createDataFrame([(200000001, 200000016)], "mmsi_a long, mmsi_b long")
    for name, df in windowed(table, pairs):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
        assert scans, name
        pushed = [x.split("PushedFilters:")[1] for x in scans if "latitude" in x]
        assert pushed and all("base_date_time" in x for x in pushed), (name, pushed)


def test_periods_change_no_answer(fixture_points, spark):
    """The halo holds every leg that touches the period."""
    whole = trips.legs(trips.build_trips(fixture_points, by_name=False, numbered=False))
    near = trips.legs(trips.build_trips(fixture_points, by_name=False, numbered=False, start=START, end=END))
    touch = (F.col("ts") <= F.lit(END)) & (F.col("ts2") >= F.lit(START))
    a, b = (x.where(touch).select("mmsi", "ts", "ts2", "lon", "lat2") for x in (whole, near))
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
