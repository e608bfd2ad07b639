"""Geodesy and geometry as native column expressions (no UDF)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from seawake.schema import EARTH_M


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(value) -> Column:
    """A timestamp literal; naive datetimes and strings without a zone mean UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    delta = value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(delta // dt.timedelta(microseconds=1)))


def seconds(ts: Column | str) -> Column:
    """Epoch seconds as double, independent of the session time zone."""
    return F.unix_micros(col(ts)) / F.lit(1e6)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(1e6)


def add_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(secs * 1e6).cast("long"))


def in_period(ts: Column | str, start, end, closed: bool = True) -> Column:
    """``[start, end]`` or ``[start, end)``; always true when no period is given."""
    if start is None:
        return F.lit(True)
    ts = col(ts)
    upper = ts <= instant(end) if closed else ts < instant(end)
    return (ts >= instant(start)) & upper


def hav_m(lon1, lat1, lon2, lat2, radius: float = EARTH_M) -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    lon1, lat1, lon2, lat2 = col(lon1), col(lat1), col(lon2), col(lat2)
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(2.0 * radius) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def wrap360(deg: Column) -> Column:
    """Degrees into [0, 360)."""
    return F.pmod(deg, F.lit(360.0))


def wrap180(diff: Column) -> Column:
    """A difference of two headings in [0, 360) into [-180, 180]."""
    return F.when(diff > 180, diff - 360).when(diff < -180, diff + 360).otherwise(diff)


def bearing_deg(lon1, lat1, lon2, lat2) -> Column:
    """Initial great-circle bearing in [0, 360); NULL for coincident points."""
    lon1, lat1, lon2, lat2 = col(lon1), col(lat1), col(lon2), col(lat2)
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.when((lon1 != lon2) | (lat1 != lat2), wrap360(F.degrees(F.atan2(y, x))))


def cell_id(value, size: float) -> Column:
    """Integer id of the nearest grid line; multiply by ``size`` for its coordinate."""
    return F.floor(col(value) / F.lit(float(size)) + F.lit(0.5))


def time_bucket(ts, bucket_s: int) -> Column:
    """Integer bucket of ``bucket_s`` seconds since the epoch."""
    return F.floor(F.unix_micros(col(ts)) / F.lit(bucket_s * 1_000_000))


def bucket_start(bucket: Column, bucket_s: int) -> Column:
    return F.timestamp_micros(bucket * F.lit(bucket_s * 1_000_000))


# --- polygons -------------------------------------------------------------------
# A polygon is carried as ``edges array<struct<x1,y1,x2,y2>>`` over all its rings, so
# the even-odd rule also handles holes.


def ring_edges(ring: Column) -> Column:
    """Edges of one closed ring ``array<struct<x,y>>``."""
    return F.transform(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda p, i: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), ring[i + 1]["x"].alias("x2"), ring[i + 1]["y"].alias("y2")
        ),
    )


def on_boundary(x: Column, y: Column, edges: Column) -> Column:
    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return F.exists(edges, touches)


def _odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    # the division is only reached for edges that span y, hence never by zero
    def guarded(e: Column) -> Column:
        return F.when((e["y1"] > y) != (e["y2"] > y), crosses(e)).otherwise(False)

    return F.size(F.filter(edges, guarded)) % 2 == 1


def point_in_edges(x, y, edges, bbox: Column | None = None) -> Column:
    """Strict containment (boundary excluded); false for NULL coordinates."""
    x, y, edges = col(x), col(y), col(edges)
    known = x.isNotNull() & y.isNotNull()
    if bbox is not None:
        known = known & in_box(x, y, bbox)
    return F.when(known, _odd_crossings(x, y, edges) & ~on_boundary(x, y, edges)).otherwise(False)


def point_in_ring(x, y, ring) -> Column:
    """Strict containment in one closed ring ``array<struct<x,y>>``."""
    return point_in_edges(x, y, ring_edges(col(ring)))


def in_box(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["xmin"], box["xmax"]) & y.between(box["ymin"], box["ymax"])


def leg_meets_edges(x1, y1, x2, y2, edges) -> Column:
    """A straight leg touches the closed polygon: an end inside or an edge crossed."""
    x1, y1, x2, y2, edges = col(x1), col(y1), col(x2), col(y2), col(edges)

    def side(ax, ay, bx, by, px, py):
        return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    def cut(e: Column) -> Column:
        d1 = side(e["x1"], e["y1"], e["x2"], e["y2"], x1, y1)
        d2 = side(e["x1"], e["y1"], e["x2"], e["y2"], x2, y2)
        d3 = side(x1, y1, x2, y2, e["x1"], e["y1"])
        d4 = side(x1, y1, x2, y2, e["x2"], e["y2"])
        boxes = (
            (F.greatest(x1, x2) >= F.least(e["x1"], e["x2"]))
            & (F.least(x1, x2) <= F.greatest(e["x1"], e["x2"]))
            & (F.greatest(y1, y2) >= F.least(e["y1"], e["y2"]))
            & (F.least(y1, y2) <= F.greatest(e["y1"], e["y2"]))
        )
        return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)

    return _odd_crossings(x1, y1, edges) | _odd_crossings(x2, y2, edges) | F.exists(edges, cut)


# --- minimum bounding boxes -----------------------------------------------------
# struct<xmin,xmax,ymin,ymax double, tmin,tmax timestamp>


def mbb_volume(box) -> Column:
    """Area in square degrees times duration in seconds."""
    b = col(box)
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"]) * seconds_between(b["tmin"], b["tmax"])


def mbb_intersects(a, b) -> Column:
    """Closed intersection in x, y and t."""
    a, b = col(a), col(b)
    return (
        (a["xmin"] <= b["xmax"])
        & (a["xmax"] >= b["xmin"])
        & (a["ymin"] <= b["ymax"])
        & (a["ymax"] >= b["ymin"])
        & (a["tmin"] <= b["tmax"])
        & (a["tmax"] >= b["tmin"])
    )


def mbb_contains(a, b) -> Column:
    """Box ``a`` contains box ``b``."""
    a, b = col(a), col(b)
    return (
        (a["xmin"] <= b["xmin"])
        & (a["xmax"] >= b["xmax"])
        & (a["ymin"] <= b["ymin"])
        & (a["ymax"] >= b["ymax"])
        & (a["tmin"] <= b["tmin"])
        & (a["tmax"] >= b["tmax"])
    )
