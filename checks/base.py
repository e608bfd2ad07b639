"""Shared parts of the checks: fixed parameters, rounding, and SQL building blocks.

Each query wraps a library operator: it feeds the whole table, picks the columns to
compare and rounds doubles.  The SQL side states the same result on its own, straight from
the ``events`` table.  Times are compared as whole epoch seconds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.fixture import points_from_events as points  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def utc(hour: int, minute: int = 0) -> dt.datetime:
    return dt.datetime(2025, 1, 1, hour, minute, tzinfo=dt.timezone.utc)


START, END = utc(2), utc(10)
T0, T1 = int(START.timestamp()), int(END.timestamp())

# (min_lon, min_lat, max_lon, max_lat)
VIEWPORT = (120.7, 30.2, 123.3, 31.6)

ZONES = [
    {
        "name": "A",
        "geometry": {
            "type": "Polygon",
            "coordinates": [[[121.0, 30.2], [121.3, 30.5], [121.0, 30.8], [120.9, 30.5], [121.0, 30.2]]],
        },
    },
    {
        "name": "B",
        "geometry": {
            "type": "Polygon",
            "coordinates": [
                [[121.5, 30.4], [122.2, 30.4], [122.2, 31.2], [121.9, 30.7], [121.5, 31.2], [121.5, 30.4]]
            ],
        },
    },
]

PORT_ROWS = [(1, "port 1", 121.0, 30.4, 121.3, 30.7), (2, "port 2", 122.2, 31.0, 122.6, 31.3)]


def ports(spark: SparkSession) -> DataFrame:
    from seawake.operators.zones import ports_from_bboxes

    cols = "id long, name string, bbox_min_lon double, bbox_min_lat double, bbox_max_lon double, bbox_max_lat double"
    return ports_from_bboxes(spark.createDataFrame(PORT_ROWS, cols))


def zones(spark: SparkSession) -> DataFrame:
    from seawake.sources.zones import zones_from_geojson

    return zones_from_geojson(ZONES, spark)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vessel with the one whose number is 15 higher: same area and speed class."""
    v = points(spark, sf_dir).select("mmsi").distinct()
    other = v.select((F.col("mmsi") - 15).alias("mmsi_a"), F.col("mmsi").alias("mmsi_b"))
    return other.join(v.select(F.col("mmsi").alias("mmsi_a")), "mmsi_a").select("mmsi_a", "mmsi_b")


# --- rounding, the same in both engines -----------------------------------------


def q(c: Column | str, digits: int = 6) -> Column:
    """Round half up; the half is nudged so that exact halves do not depend on the last bit."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.floor(c * scale + 0.50001) / scale


def sec(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.unix_micros(c) / F.lit(1e6))


def Q(expr: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.50001::DOUBLE) / 1e{digits}"


def I(expr: str) -> str:  # noqa: E743
    return f"CAST({expr} AS BIGINT)"


# --- SQL building blocks --------------------------------------------------------

POINTS_SQL = """
e AS (
  SELECT event_id, event_type, value, user_id AS u,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k,
         (epoch_us(ts) - 1704067200000000) // 60000000 AS s
  FROM events
), m AS (
  SELECT *, ((u // 15) * 0.03::DOUBLE + (s / 3600.0::DOUBLE)
             * (CASE WHEN u % 7 = 3 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + 0.25::DOUBLE * (u % 3) END)) % 4.0::DOUBLE AS ph
  FROM e
), p AS (
  SELECT 200000000 + u AS mmsi, 1735689600 + s AS t,
    CASE WHEN event_id % 101 <> 0 THEN floor((121.0::DOUBLE + (u % 5) * 0.5::DOUBLE
      + 0.3::DOUBLE * (abs(ph - 2.0::DOUBLE) - 1.0::DOUBLE)) * 1e6 + 0.5::DOUBLE) / 1e6 END AS lon,
    CASE WHEN event_id % 101 <> 0 THEN floor((30.5::DOUBLE + (u % 5) * 0.2::DOUBLE
      + 0.3::DOUBLE * (abs((ph + 1.0::DOUBLE) % 4.0::DOUBLE - 2.0::DOUBLE) - 1.0::DOUBLE)) * 1e6 + 0.5::DOUBLE) / 1e6
      END AS lat,
    CASE WHEN event_id % 89 <> 0 THEN CASE WHEN u % 7 = 3 THEN value / 200.0::DOUBLE ELSE value / 5.0::DOUBLE END END AS sog,
    CASE WHEN event_id % 83 <> 0 THEN k * 3.6::DOUBLE END AS cog,
    k * 3.6::DOUBLE AS heading,
    CASE WHEN event_id % 97 <> 0 THEN 'VESSEL ' || u END AS vessel_name,
    '98' || u AS imo, 'C' || u AS call_sign,
    CAST([30, 60, 70, 80, 0][u % 5 + 1] AS BIGINT) AS vessel_type,
    CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2
                    WHEN 'signup' THEN 5 WHEN 'view' THEN 15 END AS status,
    CAST(50 + 10 * (u % 35) AS DOUBLE) AS length, CAST(10 + u % 20 AS DOUBLE) AS width,
    CAST(3 + u % 12 AS DOUBLE) AS draft, CAST([30, 60, 70, 80, 0][u % 5 + 1] AS BIGINT) AS cargo,
    CASE WHEN u % 2 = 0 THEN 'A' ELSE 'B' END AS transceiver, event_id AS src_id
  FROM m
), op AS (
  SELECT * FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY mmsi, t ORDER BY src_id) = 1
)"""


def with_points(*ctes: str) -> str:
    return "WITH " + ", ".join([POINTS_SQL.strip(), *[c.strip() for c in ctes]])


def seq_sql(name: str, src: str, keys: str, gap: int, numbered: str = "seq_id") -> str:
    """Gap-and-island numbering (from 1) and the next row of the same sequence."""
    return f"""
{name}_g AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) > {gap} THEN 1 ELSE 0 END AS cut FROM {src}
), {name}_s AS (
  SELECT *, 1 + sum(cut) OVER (PARTITION BY {keys} ORDER BY t) AS {numbered} FROM {name}_g
), {name} AS (
  SELECT *,
    lead(t) OVER w AS t2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2,
    lag(t) OVER w AS t0, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0
  FROM {name}_s WINDOW w AS (PARTITION BY {keys}, {numbered} ORDER BY t)
)"""


#: trips per vessel name (NULL names form their own trip) and per vessel
TRIPS_SQL = seq_sql("tr", "(SELECT *, coalesce('=' || vessel_name, '') AS nk FROM op)", "mmsi, nk", 3600)
VTRIPS_SQL = seq_sql("vt", "op", "mmsi", 3600)
SEGMENTS_SQL = seq_sql("sg", "op", "mmsi", 1800, "segment_id")


def hav(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6371000.0) -> str:
    return (
        f"(2 * {radius!r}::DOUBLE * asin(least(sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)), 1.0)))"
    )


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    b = (
        f"degrees(atan2(sin(radians(({lon2}) - ({lon1}))) * cos(radians({lat2})),"
        f" cos(radians({lat1})) * sin(radians({lat2}))"
        f" - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians(({lon2}) - ({lon1})))))"
    )
    return f"CASE WHEN ({lon1}) <> ({lon2}) OR ({lat1}) <> ({lat2}) THEN (({b}) % 360 + 360) % 360 END"


def cell(expr: str, size: float) -> str:
    return f"CAST(floor(({expr}) / {size!r}::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def ring_sql(ring: list) -> list[tuple]:
    return [(*a, *b) for a, b in zip(ring[:-1], ring[1:])]


def inside_sql(x: str, y: str, ring: list, strict: bool = True) -> str:
    """Point in polygon from an explicit edge list; ``strict`` leaves the boundary out."""
    odd, edge = [], []
    for x1, y1, x2, y2 in ring_sql(ring):
        d = lambda v: f"{v!r}::DOUBLE"
        odd.append(
            f"CASE WHEN (({d(y1)} > {y}) <> ({d(y2)} > {y})) AND {x} < ({d(x2)} - {d(x1)}) * ({y} - {d(y1)})"
            f" / ({d(y2)} - {d(y1)}) + {d(x1)} THEN 1 ELSE 0 END"
        )
        edge.append(
            f"(({d(x2)} - {d(x1)}) * ({y} - {d(y1)}) - ({d(y2)} - {d(y1)}) * ({x} - {d(x1)}) = 0"
            f" AND {x} BETWEEN {d(min(x1, x2))} AND {d(max(x1, x2))} AND {y} BETWEEN {d(min(y1, y2))} AND {d(max(y1, y2))})"
        )
    inside = f"((({' + '.join(odd)}) % 2) = 1)"
    return f"({inside} AND NOT ({' OR '.join(edge)}))" if strict else inside


def zones_sql() -> str:
    """``zp``: positions inside a zone."""
    parts = [
        f"SELECT {i} AS zone_id, '{z['name']}' AS zone_name, mmsi, t, lon, lat, src_id FROM p "
        f"WHERE lon IS NOT NULL AND lat IS NOT NULL AND {inside_sql('lon', 'lat', z['geometry']['coordinates'][0])}"
        for i, z in enumerate(ZONES, 1)
    ]
    return "zp AS (" + " UNION ALL ".join(parts) + ")"


def ports_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for i, n, a, b, c, d in PORT_ROWS)
    return f"port(port_id, port_name, x1, y1, x2, y2) AS (VALUES {rows})"


PAIRS_SQL = """
pr AS (
  SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b
  FROM (SELECT DISTINCT mmsi FROM p) a JOIN (SELECT DISTINCT mmsi FROM p) b ON b.mmsi = a.mmsi + 15
)"""
