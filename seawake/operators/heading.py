"""Heading analysis (H1-H3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.functions.geo import bearing_deg, cell_id, in_period, seconds_between, wrap180
from seawake.operators.trips import around_period, ordered_points
from seawake.plans.joins import fullest
from seawake.plans.sliced import chain, link_within, time_slice
from seawake.schema import TRIP_GAP_S, check_period


def _leg_headings(points: DataFrame, start=None, end=None, mmsi: int | None = None) -> DataFrame:
    """Azimuth at every instant that starts a moving leg; NULL elsewhere."""
    t = ordered_points(around_period(points, start, end), mmsi=mmsi).select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        "cog",
    )
    t = link_within(t, ["mmsi"], "ts", ["ts", "lon", "lat"], TRIP_GAP_S).where(in_period("ts", start, end))
    return t.select("mmsi", "ts", "lon", "lat", "cog", bearing_deg("lon", "lat", "next.lon", "next.lat").alias("azimuth"))


def heading_series(points: DataFrame, start=None, end=None, mmsi: int | None = None) -> DataFrame:
    """H1 rows: heading, wrapped change and turn rate in degrees per minute.

    Heading is the azimuth of the leg that starts at the instant.  A vessel with fewer
    than two such headings falls back to its reported course.
    """
    check_period(start, end)
    t = _leg_headings(points, start, end, mmsi)
    moving = t.groupBy("mmsi").agg((F.count("azimuth") >= 2).alias("_moves"))
    heading = F.when(F.col("_moves"), F.col("azimuth")).otherwise(F.col("cog"))
    chosen = t.join(moving, "mmsi").withColumn("heading", heading).where(F.col("heading").isNotNull())
    linked = chain(chosen.select("mmsi", "ts", "heading", "lon", "lat"), ["mmsi"], ["ts"], ["ts", "heading"], time_slice("ts"))
    diff = wrap180(F.col("heading") - F.col("prev.heading"))
    minutes = seconds_between("prev.ts", "ts") / 60
    return linked.select(
        "mmsi",
        "ts",
        "heading",
        "lon",
        "lat",
        F.col("prev.heading").alias("heading_before"),
        diff.alias("turn_deg"),
        (diff / minutes).alias("turn_rate"),
    )


def heading_analysis(points: DataFrame, start=None, end=None, mmsi: int | None = None) -> DataFrame:
    """H1: heading statistics per vessel.

    ``avg_heading`` and ``heading_std`` treat degrees as plain numbers;
    ``circular_mean`` is the direction of the mean vector.
    """
    h = F.radians("heading")
    return (
        heading_series(points, start, end, mmsi)
        .groupBy("mmsi")
        .agg(
            F.count("*").alias("n_points"),
            F.min("heading").alias("min_heading"),
            F.max("heading").alias("max_heading"),
            F.avg("heading").alias("avg_heading"),
            F.coalesce(F.stddev_samp("heading"), F.lit(0.0)).alias("heading_std"),
            F.coalesce(F.sum(F.abs("turn_deg")), F.lit(0.0)).alias("total_turn_deg"),
            F.pmod(F.degrees(F.atan2(F.avg(F.sin(h)), F.avg(F.cos(h)))), F.lit(360.0)).alias("circular_mean"),
        )
    )


def turn_events(
    points: DataFrame, start=None, end=None, threshold: float = 5.0, mmsi: int | None = None
) -> DataFrame:
    """H2: instants with an absolute turn rate above ``threshold`` degrees per minute."""
    return (
        heading_series(points, start, end, mmsi)
        .where(F.abs("turn_rate") > threshold)
        .select(
            "mmsi",
            "ts",
            "heading_before",
            F.col("heading").alias("heading_after"),
            "turn_deg",
            "turn_rate",
            "lon",
            "lat",
        )
    )


def heading_grid(
    points: DataFrame, grid_size: float = 0.05, start=None, end=None, min_points: int = 5, top: int | None = 1000
) -> DataFrame:
    """H3: mean heading per grid cell with at least ``min_points`` headings, ``top`` fullest cells (None: all)."""
    check_period(start, end)
    g = (
        _leg_headings(points, start, end)
        .where(F.col("azimuth").isNotNull())
        .withColumnRenamed("azimuth", "heading")
        .groupBy(cell_id("lon", grid_size).alias("cell_x"), cell_id("lat", grid_size).alias("cell_y"))
        .agg(
            F.avg("heading").alias("avg_heading"),
            F.count("*").alias("n_points"),
            F.stddev_samp("heading").alias("heading_std"),
        )
        .where(F.col("n_points") >= min_points)
    )
    g = g.withColumn("lon", F.col("cell_x") * grid_size).withColumn("lat", F.col("cell_y") * grid_size)
    return fullest(g, top, F.desc("n_points"), "cell_x", "cell_y")
