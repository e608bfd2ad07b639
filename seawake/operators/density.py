"""Density and distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.functions.geo import (
    bucket_start,
    cell_id,
    in_period,
    instant,
    seconds_between,
    time_bucket,
)
from seawake.operators.trips import build_trips, legs, ordered_points
from seawake.plans.joins import fullest
from seawake.schema import M_PER_DEGREE, MS_TO_KNOTS, check_bbox, check_mmsi, check_period


def _viewport_cells(points: DataFrame, bbox: tuple[float, float, float, float], granularity: int) -> DataFrame:
    """Points in ``bbox`` (min_lon, min_lat, max_lon, max_lat) with their cell; the far edges fall out."""
    check_bbox(*bbox)
    min_lon, min_lat, max_lon, max_lat = bbox
    inside = points.where(F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon))
    row = F.floor((F.col("latitude") - min_lat) / F.lit((max_lat - min_lat) / granularity))
    column = F.floor((F.col("longitude") - min_lon) / F.lit((max_lon - min_lon) / granularity))
    return inside.select("mmsi", "longitude", "latitude", row.alias("row"), column.alias("col")).where(
        F.col("row").between(0, granularity - 1) & F.col("col").between(0, granularity - 1)
    )


def viewport_heatmap(
    points: DataFrame,
    bbox: tuple[float, float, float, float],
    start=None,
    end=None,
    granularity: int = 60,
    top: int | None = 2000,
) -> DataFrame:
    """Mean position and log-scaled intensity per viewport cell, ``top`` fullest cells (None: all)."""
    check_period(start, end)
    cells = (
        _viewport_cells(points.where(in_period("base_date_time", start, end)), bbox, granularity)
        .groupBy("row", "col")
        .agg(F.count("*").alias("n_points"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    )
    # at most granularity ** 2 cells, so the peak is a window over all of them
    peak = F.nullif(F.log(F.max("n_points").over(W.partitionBy()) + 1.0), F.lit(0.0))
    out = (
        cells.withColumn("intensity", F.least(F.log(F.col("n_points") + 1.0) / peak, F.lit(1.0)))
    )
    return fullest(out, top, F.desc("n_points"), "row", "col")


def vessel_density(
    points: DataFrame, bbox: tuple[float, float, float, float], granularity: int = 30, top: int | None = 500
) -> DataFrame:
    """Distinct vessels per viewport cell at the mean of their mean positions."""
    per_vessel = (
        _viewport_cells(points, bbox, granularity)
        .groupBy("mmsi", "row", "col")
        .agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    )
    cells = per_vessel.groupBy("row", "col").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("vessels")
    )
    peak = F.nullif(F.max("vessels").over(W.partitionBy()), F.lit(0))
    out = (
        cells.withColumn("intensity", F.least(F.col("vessels") / peak, F.lit(1.0)))
    )
    return fullest(out, top, F.desc("vessels"), "row", "col")


def _newest_trips(trips: DataFrame, max_trips: int | None) -> DataFrame:
    """Optionally keep only the trips that end latest (a report option, off by default)."""
    if max_trips is None:
        return trips
    newest = (
        trips.groupBy("mmsi", "trip_key")
        .agg(F.max("ts").alias("_end"))
        .orderBy(F.desc("_end"), "mmsi", "trip_key")
        .limit(max_trips)
    )
    return trips.join(newest.select("mmsi", "trip_key"), ["mmsi", "trip_key"], "left_semi")


def _trip_instants(points: DataFrame, start, end, max_trips: int | None) -> DataFrame:
    """Instants of all trips; ordering is not needed, so no trip is built unless limited."""
    if max_trips is None:
        return ordered_points(points, start, end).select(
            "mmsi",
            F.col("base_date_time").alias("ts"),
            F.col("longitude").alias("lon"),
            F.col("latitude").alias("lat"),
        )
    return _newest_trips(build_trips(points, numbered=False).where(in_period("ts", start, end)), max_trips)


def space_time_density(
    points: DataFrame,
    grid_size: float = 0.01,
    interval_s: int = 3600,
    start=None,
    end=None,
    top: int | None = 1000,
    max_trips: int | None = None,
) -> DataFrame:
    """D3: points and vessels per grid cell and time bucket, cells with more than one point."""
    check_period(start, end)
    cells = (
        _trip_instants(points, start, end, max_trips)
        .groupBy(
            cell_id("lon", grid_size).alias("cell_x"),
            cell_id("lat", grid_size).alias("cell_y"),
            time_bucket("ts", interval_s).alias("_b"),
            "mmsi",
        )
        .agg(F.count("*").alias("n"), F.sum("lon").alias("x"), F.sum("lat").alias("y"))
        .groupBy("cell_x", "cell_y", "_b")
        .agg(
            F.sum("n").alias("n_points"),
            F.count("*").alias("vessels"),
            (F.sum("x") / F.sum("n")).alias("avg_lon"),
            (F.sum("y") / F.sum("n")).alias("avg_lat"),
        )
        .where("n_points > 1")
    )
    out = (
        cells.withColumn("time_bucket", bucket_start(F.col("_b"), interval_s))
        .withColumn("lon", F.col("cell_x") * grid_size)
        .withColumn("lat", F.col("cell_y") * grid_size)
        .withColumn("intensity", F.least(F.lit(1.0), F.col("n_points") / 100.0))
        .drop("_b")
    )
    return fullest(out, top, F.desc("n_points"), "time_bucket", "cell_x", "cell_y")


def corridors(
    points: DataFrame,
    grid_size: float = 0.005,
    min_vessels: int = 5,
    start=None,
    end=None,
    top: int | None = 500,
    max_trips: int | None = None,
) -> DataFrame:
    """Cell-to-cell passages used by at least ``min_vessels`` vessels."""
    check_period(start, end)
    # the newest trips can only be told from the whole history
    period = {} if max_trips is not None else {"start": start, "end": end}
    trips = build_trips(points, numbered=False, **period)
    if max_trips is not None:
        trips = _newest_trips(trips, max_trips)
    g = legs(trips)
    if start is not None:
        g = g.where((F.col("ts") <= instant(end)) & (F.col("ts2") >= instant(start)))
    dx, dy = F.col("lon2") - F.col("lon"), F.col("lat2") - F.col("lat")
    keys = ["x1", "y1", "x2", "y2"]
    cells = (
        g.where((F.abs(dx) > 0.0001) | (F.abs(dy) > 0.0001))
        .select(
            cell_id("lon", grid_size).alias("x1"),
            cell_id("lat", grid_size).alias("y1"),
            cell_id("lon2", grid_size).alias("x2"),
            cell_id("lat2", grid_size).alias("y2"),
            "mmsi",
            (F.sqrt(dx * dx + dy * dy) * M_PER_DEGREE).alias("m"),
            "dt",
        )
        .groupBy(*keys, "mmsi")
        .agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("dt").alias("s"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("passages"), F.count("*").alias("vessels"), F.sum("m").alias("m"), F.sum("s").alias("s"))
        .where(F.col("vessels") >= min_vessels)
    )
    cx, cy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    direction = F.when((cx != 0) | (cy != 0), F.pmod(F.degrees(F.atan2(cx.cast("double"), cy.cast("double"))), F.lit(360.0)))
    out = cells.select(
        *keys,
        (F.col("x1") * grid_size).alias("start_lon"),
        (F.col("y1") * grid_size).alias("start_lat"),
        (F.col("x2") * grid_size).alias("end_lon"),
        (F.col("y2") * grid_size).alias("end_lat"),
        "passages",
        "vessels",
        (F.col("m") / F.col("passages")).alias("avg_length_m"),
        (F.col("s") / F.col("passages")).alias("avg_duration_s"),
        (F.col("m") / F.col("s") * MS_TO_KNOTS).alias("avg_speed_kn"),
        direction.alias("direction"),
        F.least(F.lit(1.0), F.col("vessels") / 50.0).alias("intensity"),
    )
    return fullest(out, top, F.desc("vessels"), F.desc("passages"), *keys)


def speed_grid(
    points: DataFrame,
    grid_size: float = 0.01,
    start=None,
    end=None,
    min_vessels: int = 2,
    top: int | None = 500,
    max_trips: int | None = None,
) -> DataFrame:
    """Mean of per-trip time-weighted speeds, binned by the middle of each trip's end points."""
    check_period(start, end)
    trips = build_trips(points, numbered=False)
    if max_trips is not None:
        trips = _newest_trips(trips, max_trips)
    from seawake.functions.geo import hav_m

    t = trips.select(
        "mmsi",
        "trip_key",
        "ts",
        "lon",
        "lat",
        hav_m("lon", "lat", "next.lon", "next.lat").alias("m"),
        seconds_between("ts", "next.ts").alias("s"),
    )
    per_trip = t.groupBy("mmsi", "trip_key").agg(
        F.sum("m").alias("m"),
        F.sum("s").alias("s"),
        F.min(F.struct("ts", "lon", "lat")).alias("a"),
        F.max(F.struct("ts", "lon", "lat")).alias("b"),
    )
    if start is not None:
        per_trip = per_trip.where((F.col("a.ts") <= instant(end)) & (F.col("b.ts") >= instant(start)))
    per_trip = per_trip.where(F.col("s") > 0).select(
        (F.col("m") / F.col("s")).alias("v"),
        ((F.col("a.lon") + F.col("b.lon")) / 2).alias("x"),
        ((F.col("a.lat") + F.col("b.lat")) / 2).alias("y"),
    )
    out = (
        per_trip.groupBy(cell_id("x", grid_size).alias("cell_x"), cell_id("y", grid_size).alias("cell_y"))
        .agg(
            (F.avg("v") * MS_TO_KNOTS).alias("avg_speed_kn"),
            F.count("*").alias("trips"),
            (F.stddev_samp("v") * MS_TO_KNOTS).alias("speed_std_kn"),
        )
        .where(F.col("trips") >= min_vessels)
        .withColumn("lon", F.col("cell_x") * grid_size)
        .withColumn("lat", F.col("cell_y") * grid_size)
    )
    return fullest(out, top, F.desc("avg_speed_kn"), "cell_x", "cell_y")


def time_distribution(points: DataFrame, bucket_s: int = 3600, mmsi: int | None = None) -> DataFrame:
    """Points and distinct vessels per time bucket.

    Counts per vessel first, so a busy hour is spread over its vessels.
    """
    check_mmsi(mmsi)
    p = ordered_points(points, mmsi=mmsi)
    return (
        p.groupBy(time_bucket("base_date_time", bucket_s).alias("_b"), "mmsi")
        .agg(F.count("*").alias("n"))
        .groupBy("_b")
        .agg(F.sum("n").alias("n_points"), F.count("*").alias("vessels"))
        .select(bucket_start(F.col("_b"), bucket_s).alias("time_bucket"), "n_points", "vessels")
    )
