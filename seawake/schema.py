"""Schemas and constants shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

POINT_SCHEMA = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("base_date_time", T.TimestampType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("sog", T.DoubleType()),
        T.StructField("cog", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
        T.StructField("vessel_name", T.StringType()),
        T.StructField("imo", T.StringType()),
        T.StructField("call_sign", T.StringType()),
        T.StructField("vessel_type", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("draft", T.DoubleType()),
        T.StructField("cargo", T.IntegerType()),
        T.StructField("transceiver", T.StringType()),
    ]
)

POINT_COLUMNS = POINT_SCHEMA.fieldNames()

MMSI_MIN = 100_000_000
MMSI_MAX = 999_999_999

EARTH_M = 6_371_000.0
EARTH_NM = 3440.065
MS_TO_KNOTS = 1.94384
M_PER_NM = 1852.0
M_PER_DEGREE = 111_000.0

TRIP_GAP_S = 3600
SEGMENT_GAP_S = 1800


def check_mmsi(mmsi: int | None) -> None:
    if mmsi is not None and not MMSI_MIN <= mmsi <= MMSI_MAX:
        raise ValueError(f"mmsi {mmsi} is outside {MMSI_MIN}..{MMSI_MAX}")


def check_period(start, end, max_days: float | None = None) -> None:
    """Both bounds or none, start before end, optionally at most ``max_days`` long."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    if start is None:
        return
    if not start < end:
        raise ValueError("start must be before end")
    if max_days is not None and (end - start).total_seconds() > max_days * 86_400:
        raise ValueError(f"period is longer than {max_days} days")


def check_bbox(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> None:
    if not (min_lon < max_lon and min_lat < max_lat):
        raise ValueError("bounding box needs min < max on both axes")
