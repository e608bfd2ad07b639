"""Fleet registry: search, latest state, listing, bounds, code labels (V1-V5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.schema import check_mmsi

# Vessel-type and navigation-status codes and their labels.
VESSEL_TYPES = {30: "渔船", 60: "客船", 70: "货船", 80: "油轮", 0: "其他"}
NAV_STATUS = {0: "航行中", 1: "锚泊", 2: "失控", 3: "受限", 5: "系泊", 15: "未定义"}


def _latest(points: DataFrame) -> DataFrame:
    """Newest row per vessel; ``max`` of a struct combines before the shuffle."""
    tie = ["src_id"] if "src_id" in points.columns else []
    rest = [c for c in points.columns if c not in ("mmsi", "base_date_time", *tie)]
    newest = F.max(F.struct("base_date_time", *tie, *rest)).alias("_r")
    return points.groupBy("mmsi").agg(newest).select("mmsi", "_r.*").select(*points.columns)


def search_vessels(points: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """V1: by MMSI prefix when the keyword is all digits, else by name prefix, any case.

    The name filter comes before the newest row is chosen, so a vessel matches by any
    name it ever sent, and the row shown is the newest with a matching name.
    """
    if keyword.isdigit():
        hit = points.where(F.col("mmsi").cast("string").startswith(keyword))
    else:
        hit = points.where(F.lower("vessel_name").startswith(keyword.lower()))
    return _latest(hit).select("mmsi", "vessel_name", "vessel_type", "base_date_time").orderBy("mmsi").limit(limit)


def latest_state(points: DataFrame, mmsi: int | None = None) -> DataFrame:
    """V2: newest report of each vessel; the position is NULL if either coordinate is."""
    check_mmsi(mmsi)
    p = points if mmsi is None else points.where(F.col("mmsi") == mmsi)
    known = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    return _latest(p).withColumn(
        "position", F.when(known, F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")))
    )


def count_vessels(points: DataFrame, vessel_type: int | None = None) -> DataFrame:
    p = points if vessel_type is None else points.where(F.col("vessel_type") == vessel_type)
    return p.agg(F.countDistinct("mmsi").alias("total"))


def list_vessels(points: DataFrame, page: int = 1, page_size: int = 20, vessel_type: int | None = None) -> DataFrame:
    """V3: one page of vessels by MMSI with their newest row, and the ``total``."""
    p = points if vessel_type is None else points.where(F.col("vessel_type") == vessel_type)
    rows = _latest(p.select("mmsi", "base_date_time", *[c for c in ("src_id",) if c in p.columns], "vessel_name", "vessel_type"))
    page_rows = rows.orderBy("mmsi").offset((page - 1) * page_size).limit(page_size)
    return page_rows.select("mmsi", "vessel_name", "vessel_type", "base_date_time").withColumn(
        "total", count_vessels(points, vessel_type).scalar()
    )


def fleet_center(points: DataFrame) -> DataFrame:
    """V4: bounding box of all positions and its centre."""
    return (
        points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
        .agg(
            F.min("longitude").alias("min_lon"),
            F.max("longitude").alias("max_lon"),
            F.min("latitude").alias("min_lat"),
            F.max("latitude").alias("max_lat"),
        )
        .withColumn("center_lon", (F.col("min_lon") + F.col("max_lon")) / 2)
        .withColumn("center_lat", (F.col("min_lat") + F.col("max_lat")) / 2)
    )


def _codes(spark: SparkSession, labels: dict[int, str], code: str, label: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(labels.items()), f"{code} int, {label} string"))


def decode_codes(df: DataFrame) -> DataFrame:
    """V5: add ``vessel_type_label`` and ``status_label``; unknown codes give NULL.

    The two code tables have 5 and 6 rows, hence the broadcast.
    """
    spark = df.sparkSession
    out = df.join(_codes(spark, VESSEL_TYPES, "vessel_type", "vessel_type_label"), "vessel_type", "left")
    return out.join(_codes(spark, NAV_STATUS, "status", "status_label"), "status", "left")
