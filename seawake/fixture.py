"""Position reports derived from a generic ``events`` table, for checks and benchmarks.

One user is one vessel moving around a diamond, time compressed 60-fold.  Plain
arithmetic only, so another SQL engine can reproduce every value bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_POINTS = """
WITH e AS (
  SELECT event_id, event_type, value, user_id AS u,
         cast(get_json_object(props, '$.k') AS double) AS k,
         (unix_micros(cast(ts AS timestamp)) - 1704067200000000) div 60000000 AS s
  FROM {events}
), m AS (
  SELECT *, ((u div 15) * 0.03D + (s / 3600.0D)
             * (CASE WHEN u % 7 = 3 THEN 0.0D ELSE 0.5D + 0.25D * (u % 3) END)) % 4.0D AS ph
  FROM e
)
SELECT
  200000000 + u AS mmsi,
  timestamp_micros(1735689600000000 + s * 1000000) AS base_date_time,
  CASE WHEN event_id % 101 <> 0 THEN
    floor((121.0D + (u % 5) * 0.5D + 0.3D * (abs(ph - 2.0D) - 1.0D)) * 1e6D + 0.5D) / 1e6D END AS longitude,
  CASE WHEN event_id % 101 <> 0 THEN
    floor((30.5D + (u % 5) * 0.2D + 0.3D * (abs((ph + 1.0D) % 4.0D - 2.0D) - 1.0D)) * 1e6D + 0.5D) / 1e6D
    END AS latitude,
  CASE WHEN event_id % 89 <> 0 THEN CASE WHEN u % 7 = 3 THEN value / 200.0D ELSE value / 5.0D END END AS sog,
  CASE WHEN event_id % 83 <> 0 THEN k * 3.6D END AS cog,
  k * 3.6D AS heading,
  CASE WHEN event_id % 97 <> 0 THEN concat('VESSEL ', cast(u AS string)) END AS vessel_name,
  concat('98', cast(u AS string)) AS imo,
  concat('C', cast(u AS string)) AS call_sign,
  cast(element_at(array(30, 60, 70, 80, 0), cast(u % 5 AS int) + 1) AS int) AS vessel_type,
  CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2
                  WHEN 'signup' THEN 5 WHEN 'view' THEN 15 END AS status,
  cast(50 + 10 * (u % 35) AS double) AS length,
  cast(10 + u % 20 AS double) AS width,
  cast(3 + u % 12 AS double) AS draft,
  cast(element_at(array(30, 60, 70, 80, 0), cast(u % 5 AS int) + 1) AS int) AS cargo,
  CASE WHEN u % 2 = 0 THEN 'A' ELSE 'B' END AS transceiver,
  event_id AS src_id
FROM m
"""


def points_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central ``points`` table for one test-data directory."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_POINTS, events=events)
