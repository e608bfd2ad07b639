"""Behaviour events: stops, overspeed, sharp turns, anomaly feed."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.functions.geo import hav_m, in_period, seconds_between
from seawake.operators.anchored import anchored_stops
from seawake.operators.trips import ordered_points, segment_points
from seawake.operators.zones import zone_entries
from seawake.plans.checkpoints import reliable_checkpoint
from seawake.plans.joins import sized_broadcast, spread
from seawake.plans.sliced import chain, link_within, number_runs, time_slice
from seawake.schema import EARTH_M, M_PER_DEGREE, SEGMENT_GAP_S, check_period


def detect_stops(
    points: DataFrame, dist_m: float = 500, min_minutes: float = 30, start=None, end=None
) -> DataFrame:
    """Gap-free stretches whose spread and duration look like a stop.

    Spread is stddev(lat) + stddev(lon) against ``dist_m`` in degrees.  A stretch of one
    report has no spread and drops out.
    """
    check_period(start, end)
    s = segment_points(points.where(in_period("base_date_time", start, end)))
    return (
        s.groupBy("mmsi", "segment_id")
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.avg("lon").alias("lon"),
            F.avg("lat").alias("lat"),
            F.count("*").alias("n_points"),
            (F.stddev_samp("lat") + F.stddev_samp("lon")).alias("spread_deg"),
        )
        .withColumn("duration_min", seconds_between("start_time", "end_time") / 60)
        .where((F.col("spread_deg") <= dist_m / M_PER_DEGREE) & (F.col("duration_min") >= min_minutes))
    )


def stop_totals(stops: DataFrame) -> DataFrame:
    """Number of stops and total minutes per vessel."""
    return stops.groupBy("mmsi").agg(
        F.count("*").alias("n_stops"), F.sum("duration_min").alias("total_duration_min")
    )


def overspeed_events(points: DataFrame, threshold: float = 30.0, start=None, end=None) -> DataFrame:
    """Positioned reports at or above ``threshold`` knots."""
    check_period(start, end)
    sog = F.coalesce("sog", F.lit(0.0))
    # copies of one instant are settled before the threshold: only the report that stays counts
    p = ordered_points(points, start, end).where(sog >= threshold)
    return p.select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        sog.alias("sog"),
        F.least(0.4 + (sog - threshold) / 20, F.lit(1.0)).alias("score"),
    )


def sharp_turn_events(points: DataFrame, threshold: float = 20.0, start=None, end=None) -> DataFrame:
    """Course change per minute of consecutive reports at or above ``threshold``."""
    check_period(start, end)
    p = ordered_points(points, start, end).select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        F.coalesce("sog", F.lit(0.0)).alias("sog"),
        "cog",
    )
    linked = chain(p, ["mmsi"], ["ts"], ["ts", "sog", "cog"], time_slice("ts"))
    prev = F.col("prev")
    around = F.pmod(F.abs(F.col("cog") - prev["cog"]), F.lit(360.0))
    change = F.least(around, 360.0 - around)
    minutes = seconds_between(prev["ts"], "ts") / 60
    mean_sog = (prev["sog"] + F.col("sog")) / 2
    return (
        linked.where(prev["cog"].isNotNull() & F.col("cog").isNotNull() & (minutes > 0) & (mean_sog >= 3))
        .withColumn("turn_deg", change)
        .withColumn("turn_rate", change / minutes)
        .where(F.col("turn_rate") >= threshold)
        .select(
            "mmsi",
            prev["ts"].alias("start_time"),
            F.col("ts").alias("end_time"),
            "lon",
            "lat",
            "turn_deg",
            "turn_rate",
            F.least(0.45 + (F.col("turn_rate") - threshold) / 60, F.lit(1.0)).alias("score"),
        )
    )


# --- E4: greedy anchored stops --------------------------------------------------

#: runs up to this many reports go to one Arrow task; longer ones are cut first
RUN_ROWS = 100_000

_STOP_SCHEMA = (
    "mmsi long, start_time timestamp, end_time timestamp, lon double, lat double, n_points long"
)


def _greedy_stops(radius_m: float):
    """Stops of one run, restarting at the first report beyond the radius of the anchor."""

    def stops(run: pa.Table) -> pa.Table:
        run = run.sort_by("ts")
        lon, lat = run["lon"].to_numpy(), run["lat"].to_numpy()
        rlon, rlat = np.radians(lon), np.radians(lat)
        first, last, x, y = [], [], [], []
        i, n = 0, len(lon)
        while i < n:
            j, width, lo = n, 64, i + 1
            # look for the first report outside in growing blocks
            while lo < n:
                hi = min(lo + width, n)
                a = (
                    np.sin((rlat[lo:hi] - rlat[i]) / 2) ** 2
                    + np.cos(rlat[i]) * np.cos(rlat[lo:hi]) * np.sin((rlon[lo:hi] - rlon[i]) / 2) ** 2
                )
                outside = np.flatnonzero(2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(a), 1.0)) > radius_m)
                if outside.size:
                    j = lo + int(outside[0])
                    break
                lo, width = hi, width * 2
            if j - i > 1:
                first.append(i)
                last.append(j - 1)
                x.append(float(lon[i:j].mean()))
                y.append(float(lat[i:j].mean()))
            i = j
        starts, ends = pa.array(first, pa.int64()), pa.array(last, pa.int64())
        return pa.table(
            {
                "mmsi": run["mmsi"].take(starts),
                "start_time": run["ts"].take(starts),
                "end_time": run["ts"].take(ends),
                "lon": pa.array(x, pa.float64()),
                "lat": pa.array(y, pa.float64()),
                "n_points": pa.array([b - a + 1 for a, b in zip(first, last)], pa.int64()),
            }
        )

    return stops


def slow_runs(points: DataFrame, speed: float = 1.0, start=None, end=None) -> DataFrame:
    """Runs of two or more slow reports without a faster one or a gap between, numbered per vessel."""
    p = ordered_points(points, start, end).select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        F.coalesce("sog", F.lit(0.0)).alias("sog"),
    )

    p = link_within(p, ["mmsi"], "ts", ["ts", "sog"], SEGMENT_GAP_S).where(F.col("sog") <= speed)
    opens = ~F.coalesce(F.col("prev.sog") <= speed, F.lit(False))
    closes = ~F.coalesce(F.col("next.sog") <= speed, F.lit(False))
    runs = number_runs(p.where(~(opens & closes)), ["mmsi"], ["ts"], opens, "run")
    return runs.select("mmsi", "run", "ts", "lon", "lat")


def abnormal_stops(
    points: DataFrame,
    speed: float = 1.0,
    min_minutes: float = 30,
    radius_m: float = 500,
    start=None,
    end=None,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Stays within ``radius_m`` of their first report, greedily one after another.

    Only the radius test is sequential, so runs are cut by windows first; runs of
    one report hold no stop and never reach Python.  Runs of more than
    ``run_rows`` reports never enter a task as a whole: ``anchored.anchored_stops`` finds their stops block by
    block, in rounds logarithmic in the number of blocks.  The result is the same for any ``run_rows``.
    """
    check_period(start, end)
    keys = ["mmsi", "run"]
    runs = slow_runs(points, speed, start, end)
    n_rows = F.count("*").alias("n")
    # a vessel with few slow reports has no long run: settle that on a cheap count first
    slow = points.where((F.coalesce("sog", F.lit(0.0)) <= speed) & in_period("base_date_time", start, end))
    some_long = not slow.groupBy("mmsi").agg(n_rows).where(F.col("n") > run_rows).isEmpty()
    short = runs = reliable_checkpoint(runs) if some_long else runs
    if some_long:
        long_runs = sized_broadcast(runs.groupBy(*keys).agg(n_rows).where(F.col("n") > run_rows).select(*keys))
        short = runs.join(long_runs, keys, "left_anti")
    stops = spread(short, keys).groupBy(*keys).applyInArrow(_greedy_stops(radius_m), _STOP_SCHEMA)
    if some_long:
        stops = stops.unionByName(anchored_stops(runs.join(long_runs, keys, "left_semi"), radius_m, run_rows))
    return (
        stops.withColumn("duration_min", seconds_between("start_time", "end_time") / 60)
        .where(F.col("duration_min") >= min_minutes)
        .withColumn("score", F.least(0.5 + F.col("duration_min") / 240, F.lit(1.0)))
    )


def severity(score: Column | str) -> Column:
    """E5: high from 0.8, medium from 0.5, else low."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0.8, "high").when(s >= 0.5, "medium").otherwise("low")


@dataclass(frozen=True)
class AnomalyParams:
    """Thresholds of the unified feed."""

    overspeed_kn: float = 30.0
    turn_rate: float = 20.0
    stop_speed_kn: float = 1.0
    stop_minutes: float = 30.0
    stop_radius_m: float = 500.0
    start: dt.datetime | None = None
    end: dt.datetime | None = None


def _evidence(*names: str) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


def detect_anomalies(
    points: DataFrame, zones: DataFrame | None = None, params: AnomalyParams = AnomalyParams()
) -> DataFrame:
    """One feed of zone entries, overspeed, sharp turns and abnormal stops.

    Vessels with fewer than two positioned reports in the period give no events.  Rows
    carry type, severity, score, times, position and evidence; sort by (start, -score)
    when reading, a global sort is left to the caller.
    """
    span = {"start": params.start, "end": params.end}
    position = F.struct("lon", "lat").alias("position")

    def event(df: DataFrame, kind: str, start_col: str, end_col: str, zone: str | None, *proof: str) -> DataFrame:
        return df.select(
            "mmsi",
            F.lit(kind).alias("event_type"),
            severity("score").alias("severity"),
            "score",
            F.col(start_col).alias("start_time"),
            F.col(end_col).alias("end_time"),
            position,
            (F.col(zone) if zone else F.lit(None).cast("string")).alias("zone_name"),
            _evidence(*proof).alias("evidence"),
        )

    feed = event(overspeed_events(points, params.overspeed_kn, **span), "overspeed", "ts", "ts", None, "sog")
    feed = feed.unionByName(
        event(
            sharp_turn_events(points, params.turn_rate, **span),
            "sharp_turn", "start_time", "end_time", None, "turn_rate", "turn_deg",
        )
    ).unionByName(
        event(
            abnormal_stops(points, params.stop_speed_kn, params.stop_minutes, params.stop_radius_m, **span),
            "abnormal_stop", "start_time", "end_time", None, "duration_min", "n_points",
        )
    )
    if zones is not None:
        feed = feed.unionByName(
            event(
                zone_entries(points, zones, **span),
                "forbidden_area_entry", "start_time", "end_time", "zone_name", "n_points", "zone_name",
            )
        )
    p = points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    p = p.where(in_period("base_date_time", params.start, params.end))
    eligible = p.groupBy("mmsi").agg(F.count("*").alias("n")).where("n >= 2").select("mmsi")
    return feed.join(eligible, "mmsi", "left_semi")


def anomaly_summary(events: DataFrame) -> DataFrame:
    """Events per vessel by severity, absent classes as 0."""
    counts = [F.sum((F.col("severity") == s).cast("long")).alias(s) for s in ("high", "medium", "low")]
    return events.groupBy("mmsi").agg(F.count("*").alias("n_events"), *counts)


def anomaly_types(events: DataFrame) -> DataFrame:
    """Events by type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"))
