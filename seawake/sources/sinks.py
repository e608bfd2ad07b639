"""Sinks and the de-duplication rules that go with them (SNK1-SNK7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

POINT_KEY = ("mmsi", "base_date_time")
SEGMENT_KEY = ("mmsi", "trip_hash")


def _ordering(df: DataFrame, keep: str, keys: Sequence[str]) -> list[Column]:
    """Ingest order when there is one, else the whole row: a total order either way."""
    cols = ["src_id"] if "src_id" in df.columns else [c for c in df.columns if c not in keys]
    return [F.asc_nulls_last(c) if keep == "first" else F.desc_nulls_last(c) for c in cols]


def dedupe_points(df: DataFrame, keep: str = "last", keys: Sequence[str] = POINT_KEY) -> DataFrame:
    """SNK3: one row per key, the first or last stored one.

    Spark turns ``row_number() = 1`` into a group limit before the shuffle, so a heap of
    copies under one key shrinks to one row per input task first.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    w = W.partitionBy(*keys).orderBy(*_ordering(df, keep, keys))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def append_points(new: DataFrame, existing: DataFrame, keys: Sequence[str] = POINT_KEY) -> DataFrame:
    """SNK1: the rows of ``new`` to append; rows already stored win, then the first new one."""
    return dedupe_points(new, keep="first", keys=keys).join(
        existing.select(*keys).distinct(), list(keys), "left_anti"
    )


def append_segments(new: DataFrame, existing: DataFrame) -> DataFrame:
    """SNK2: as ``append_points``, unique on (mmsi, trip_hash)."""
    return append_points(new, existing, SEGMENT_KEY)


def write_points(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK1/SNK4 writer: date-partitioned, sorted by vessel and time inside each file.

    ``mode='overwrite'`` is truncate-and-load.  The layout lets a time filter prune
    directories and a vessel filter skip row groups by min/max.  Range partitioning
    cuts a busy vessel-day into several files of equal size.
    """
    layout = ["event_date", "mmsi", "base_date_time"]
    (
        df.withColumn("event_date", F.to_date("base_date_time"))
        .repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )


def write_samples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK5: learning samples as Parquet."""
    df.write.mode(mode).parquet(path)


def to_geojson(df: DataFrame, by: Sequence[str] = ("mmsi",), slice_s: int = 3600) -> DataFrame:
    """SNK6: one GeoJSON LineString per key from flat ``ts, lon, lat`` rows.

    A line is one value, so its coordinates end in one row; they are gathered and sorted
    per time slice first.
    """
    from seawake.operators.trips import collect_ordered
    from seawake.plans.sliced import time_slice

    d = df.withColumn("_sl", time_slice("ts", slice_s))
    lines = collect_ordered(d, list(by), "_sl", F.struct("ts", "lon", "lat"), "_pts")
    coords = F.transform("_pts", lambda p: F.array(p["lon"], p["lat"]))
    return lines.select(
        *by,
        F.size("_pts").alias("n_points"),
        F.to_json(F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates"))).alias("geojson"),
    )


def bbox_to_geojson(ports: DataFrame) -> DataFrame:
    """SNK7: the bounding box of each port as a GeoJSON Polygon."""
    x1, x2, y1, y2 = (F.col(c) for c in ("bbox_min_lon", "bbox_max_lon", "bbox_min_lat", "bbox_max_lat"))
    ring = F.array(*[F.array(x, y) for x, y in ((x1, y1), (x1, y2), (x2, y2), (x2, y1), (x1, y1))])
    return ports.withColumn(
        "geojson", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    )
