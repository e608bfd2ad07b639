"""Zones, ports and areas (G1-G6).  G1 is ``functions.geo.point_in_edges``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.functions.geo import (
    in_period,
    instant,
    leg_meets_edges,
    point_in_edges,
    ring_edges,
    seconds_between,
)
from seawake.operators.trips import build_trips, clip_legs, collect_ordered, legs, lerp, ordered_points
from seawake.plans.cells import cell_join
from seawake.plans.checkpoints import reliable_checkpoint
from seawake.plans.joins import salted_join
from seawake.plans.sliced import chain, time_slice
from seawake.schema import check_period
from seawake.sources.zones import ring_box

#: cells along the longer side of a zone, at least; cells have one of few sizes, ``CELL_STEP`` apart
CELLS_ACROSS, CELL_STEP, CELL_LEVELS = 8, 4, 9
#: cell size of level 0, about 100 m
CELL_DEG = 1 / 1024
#: cells are widened by this much when an edge is tested against them, far beyond rounding
MARGIN_DEG = 1e-9


def _cell_size(level: Column) -> Column:
    return F.lit(CELL_DEG) * F.pow(F.lit(float(CELL_STEP)), level)


def zone_cells(zones: DataFrame) -> DataFrame:
    """The cells that cover each zone: ``zone, level, x, y, inner`` for zones numbered by ``zone``.

    The cell size follows from the zone's extent, so a zone has 8 to 32 cells along its longer side.  A cell
    met by no edge is ``inner`` if its middle is inside, so all of it is, and left out if not; the others are border cells.
    """
    box = F.col("box")
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    level = F.lit(0)
    for n in range(1, CELL_LEVELS):
        level = F.when(extent >= CELL_DEG * CELL_STEP**n * CELLS_ACROSS, n).otherwise(level)
    z = zones.select("zone", "edges", "box", level.alias("level")).withColumn("s", _cell_size(F.col("level")))
    along = lambda c: F.explode(F.sequence(F.floor(box[f"{c}min"] / F.col("s")), F.floor(box[f"{c}max"] / F.col("s"))))
    z = z.withColumn("x", along("x")).withColumn("y", along("y"))
    z = z.withColumns({"x0": F.col("x") * F.col("s"), "y0": F.col("y") * F.col("s")})
    cell = ("zone", "level", "s", "x", "y", "x0", "y0")
    met = z.select(*cell, F.exists("edges", _edge_meets_cell).alias("met"), "edges")
    middle = point_in_edges(F.col("x0") + F.col("s") / 2, F.col("y0") + F.col("s") / 2, "edges")
    found = met.select("zone", "level", "x", "y", (~F.col("met") & middle).alias("inner"), "met")
    return found.where("inner or met").drop("met")


def _edge_meets_cell(e: Column) -> Column:
    """Whether an edge may touch the closed cell: their boxes overlap and the corners lie on both sides of its line."""
    x0, y0 = F.col("x0") - MARGIN_DEG, F.col("y0") - MARGIN_DEG
    x1, y1 = F.col("x0") + F.col("s") + MARGIN_DEG, F.col("y0") + F.col("s") + MARGIN_DEG
    boxes = (
        (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["x1"], e["x2"]) <= x1)
        & (F.greatest(e["y1"], e["y2"]) >= y0) & (F.least(e["y1"], e["y2"]) <= y1)
    )
    side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    return boxes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _numbered(zones: DataFrame) -> DataFrame:
    """Zones with a number of their own, written once so that it stays."""
    return reliable_checkpoint(zones.withColumn("zone", F.monotonically_increasing_id()))


def _near_zones(points: DataFrame, numbered: DataFrame, lon: str, lat: str) -> DataFrame:
    """Every (position, zone) whose cell belongs to the zone's cover, with ``zone`` and ``inner``.

    A position has one cell for each cell size that occurs among the zones.
    """
    cells = reliable_checkpoint(zone_cells(numbered))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    sizes = F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")
    p = points.withColumn("_level", F.explode(sizes))
    size = _cell_size(F.col("_level"))
    p = p.withColumns({"_x": F.floor(F.col(lon) / size), "_y": F.floor(F.col(lat) / size)})
    keys = ["_level", "_x", "_y"]
    near = cells.select(F.col("level").alias("_level"), F.col("x").alias("_x"), F.col("y").alias("_y"), "zone", "inner")
    return salted_join(p, near, keys).drop(*keys)


def points_in_zones(points: DataFrame, zones: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Every (position, zone) with the position strictly inside; positions keep their columns.

    Positions meet zones on cells of two axes.  Only those in a zone's border cells are tested against its ring.
    """
    numbered = _numbered(zones)
    near = _near_zones(points, numbered, lon, lat)
    full = salted_join(near, numbered, ["zone"], weight=F.size("edges"))
    return full.where(F.col("inner") | point_in_edges(lon, lat, "edges", F.col("box"))).drop("zone", "inner")


def area_detection(points: DataFrame, zones: DataFrame, start, end) -> DataFrame:
    """Vessels whose continuous track meets a zone in ``[start, end]``.

    Enter and exit are the first and last report strictly inside; they stay NULL for a
    vessel that crosses between two reports.  ``inside_track`` needs two reports inside.
    """
    check_period(start, end)
    trips = build_trips(points, by_name=False, numbered=False, start=start, end=end)
    leg = clip_legs(legs(trips), start, end)
    f1 = seconds_between("ts", "t1") / F.col("dt")
    f2 = seconds_between("ts", "t2") / F.col("dt")
    leg = leg.select(
        "mmsi",
        lerp(F.col("lon"), F.col("lon2"), f1).alias("x1"),
        lerp(F.col("lat"), F.col("lat2"), f1).alias("y1"),
        lerp(F.col("lon"), F.col("lon2"), f2).alias("x2"),
        lerp(F.col("lat"), F.col("lat2"), f2).alias("y2"),
    )
    # a report without a leg in the period is a degenerate one
    alone = trips.where(in_period("ts", start, end) & (F.col("next").isNull() | (F.col("ts") == instant(end)))).select(
        "mmsi", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2")
    )
    span = F.struct(
        F.least("x1", "x2").alias("xmin"), F.greatest("x1", "x2").alias("xmax"),
        F.least("y1", "y2").alias("ymin"), F.greatest("y1", "y2").alias("ymax"),
    )
    pieces = reliable_checkpoint(leg.unionByName(alone).withColumn("span", span))
    numbered = _numbered(zones)
    near = cell_join(pieces, "span", numbered.select("zone", F.col("box").alias("zone_box")), "zone_box", timed=False)
    a, b = F.col("span"), F.col("zone_box")
    near = near.where((a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"]))
    entered = (
        salted_join(near.drop("zone_box", "span"), numbered, ["zone"], weight=F.size("edges"))
        .where(leg_meets_edges("x1", "y1", "x2", "y2", "edges"))
        .select("mmsi", "zone_id", F.col("name").alias("zone_name"))
        .distinct()
    )
    p = ordered_points(points, start, end).select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
    )
    inside = points_in_zones(p, zones, "lon", "lat").withColumn("_sl", time_slice("ts"))
    keys = ["mmsi", "zone_id"]
    stay = inside.groupBy(*keys).agg(
        F.min("ts").alias("enter_time"), F.max("ts").alias("exit_time"), F.count("*").alias("n_inside")
    )
    track = collect_ordered(inside, keys, "_sl", F.struct("ts", "lon", "lat"), "_track")
    return (
        entered.join(stay, keys, "left")
        .join(track, keys, "left")
        .select(
            "mmsi",
            "zone_id",
            "zone_name",
            "enter_time",
            "exit_time",
            (seconds_between("enter_time", "exit_time") / 60).alias("stay_minutes"),
            F.coalesce("n_inside", F.lit(0)).alias("n_inside"),
            F.when(F.col("n_inside") >= 2, F.col("_track")).alias("inside_track"),
        )
    )


def zone_entries(points: DataFrame, zones: DataFrame, start=None, end=None) -> DataFrame:
    """One forbidden-zone event per (vessel, zone) with reports inside."""
    check_period(start, end)
    p = points.where(in_period("base_date_time", start, end)).select(
        "mmsi", "base_date_time", "longitude", "latitude"
    )
    g = points_in_zones(p, zones).groupBy("mmsi", "zone_id", F.col("name").alias("zone_name"))
    return g.agg(
        F.count("*").alias("n_points"),
        F.min("base_date_time").alias("start_time"),
        F.max("base_date_time").alias("end_time"),
        F.avg("longitude").alias("lon"),
        F.avg("latitude").alias("lat"),
    ).withColumn("score", F.least(0.6 + F.col("n_points") / 200, F.lit(1.0)))


def _port_zones(ports: DataFrame) -> DataFrame:
    edges = ring_edges(F.col("ring"))
    return ports.select(
        F.col("id").alias("port_id"), F.col("name").alias("port_name"), edges.alias("edges")
    ).withColumn("box", ring_box(F.col("edges")))


def port_presence(points: DataFrame, ports: DataFrame, start, end) -> DataFrame:
    """Reports inside a port, flagged when they begin or end a stay.

    Only reports inside some port are kept: each already carries its neighbours, so
    entry and exit need no row per (report, port).
    """
    check_period(start, end)
    p = ordered_points(points, start, end).select("mmsi", "base_date_time", "longitude", "latitude")
    payload = ["base_date_time", "longitude", "latitude"]
    linked = chain(p, ["mmsi"], ["base_date_time"], payload, time_slice("base_date_time"))
    inside = points_in_zones(linked, _port_zones(ports))
    around = lambda n: point_in_edges(
        F.col(n)["longitude"], F.col(n)["latitude"], "edges", F.col("box")
    )
    return inside.select(
        "port_id",
        "port_name",
        "mmsi",
        "base_date_time",
        (~around("prev")).alias("is_entry"),
        F.when(F.col("next").isNotNull() & ~around("next"), F.col("next.base_date_time")).alias("exit_time"),
    )


def port_stays(points: DataFrame, ports: DataFrame, start, end) -> DataFrame:
    """One row per stay: entry, exit (NULL while open) and minutes, an open stay counting to ``end``.

    Entries and exits alternate, so the k-th entry belongs to the next row that has an
    exit; only these border rows are shuffled.
    """
    border = port_presence(points, ports, start, end).where("is_entry or exit_time is not null")
    keys = ["port_id", "mmsi"]
    linked = chain(
        border.select(*keys, "base_date_time", "is_entry", "exit_time"),
        keys,
        ["base_date_time"],
        ["exit_time"],
        time_slice("base_date_time", 86_400),
    )
    exit_time = F.coalesce(F.col("exit_time"), F.col("next.exit_time"))
    stays = linked.where("is_entry").select(
        *keys, F.col("base_date_time").alias("entry_time"), exit_time.alias("exit_time")
    )
    minutes = seconds_between("entry_time", F.coalesce("exit_time", instant(end))) / 60
    return stays.withColumn("stay_minutes", F.greatest(minutes, F.lit(0.0)))


def _vessel_stays(points: DataFrame, ports: DataFrame, start, end) -> DataFrame:
    """Entries, exits and total stay per (port, vessel).

    Entries and exits alternate, so the total is the sum of exit times, with ``end`` for an open
    stay, minus the sum of entry times: nothing has to be paired.
    """
    p = port_presence(points, ports, start, end)
    entry = F.when(F.col("is_entry"), seconds_between(instant(start), "base_date_time"))
    left = seconds_between(instant(start), "exit_time")
    return (
        p.groupBy("port_id", "mmsi")
        .agg(
            F.count(entry).alias("entries"),
            F.count("exit_time").alias("exits"),
            F.coalesce(F.sum(entry), F.lit(0.0)).alias("_in"),
            F.coalesce(F.sum(left), F.lit(0.0)).alias("_out"),
        )
        .withColumn("_open", (F.col("entries") - F.col("exits")) * seconds_between(instant(start), instant(end)))
        .withColumn("stay_minutes", (F.col("_out") + F.col("_open") - F.col("_in")) / 60)
        .drop("_in", "_out", "_open")
    )


def port_analysis(points: DataFrame, ports: DataFrame, start, end) -> DataFrame:
    """Vessels, entries, exits, total and mean stay per port in ``[start, end]``."""
    stays = _vessel_stays(points, ports, start, end).groupBy("port_id").agg(
        F.count("*").alias("vessels"),
        F.sum("entries").alias("entries"),
        F.sum("exits").alias("exits"),
        F.sum("stay_minutes").alias("total"),
    )
    zero = F.lit(0)
    return (
        ports.select(F.col("id").alias("port_id"), F.col("name").alias("port_name"))
        .join(stays, "port_id", "left")
        .select(
            "port_id",
            "port_name",
            F.coalesce("vessels", zero).alias("vessels"),
            F.coalesce("entries", zero).alias("entries"),
            F.coalesce("exits", zero).alias("exits"),
            F.coalesce("total", F.lit(0.0)).alias("total_stay_minutes"),
            F.coalesce(F.col("total") / F.nullif(F.col("entries"), zero), F.lit(0.0)).alias("avg_stay_minutes"),
        )
    )


def port_top_vessels(points: DataFrame, ports: DataFrame, start, end, top_n: int = 5) -> DataFrame:
    """Per port the vessels with most stay minutes, then most visits, with their newest name."""
    from pyspark.sql.window import Window as W

    totals = _vessel_stays(points, ports, start, end).withColumnRenamed("entries", "visits")
    w = W.partitionBy("port_id").orderBy(F.desc("stay_minutes"), F.desc("visits"), F.asc("mmsi"))
    top = totals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    tie = ["src_id"] if "src_id" in points.columns else []
    names = (
        points.where(F.col("vessel_name").isNotNull())
        .groupBy("mmsi")
        .agg(F.max(F.struct("base_date_time", *tie, "vessel_name")).alias("_n"))
        .select("mmsi", "_n.vessel_name")
    )
    return top.join(names, "mmsi", "left").select(
        "port_id", "rank", "mmsi", "vessel_name", "stay_minutes", "visits"
    )


def ports_from_bboxes(df: DataFrame) -> DataFrame:
    """Port dimension from ``id, name, bbox_*``; rejects empty names and inverted boxes.

    Keeps ``created_at``/``updated_at`` if present, else sets both to now.
    """
    x1, y1, x2, y2 = (F.col(f"bbox_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    out = (
        df.withColumn("name", F.trim("name"))
        .where((F.length("name") > 0) & (x1 < x2) & (y1 < y2))
        .withColumn(
            "ring", F.array(corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2), corner(x1, y1))
        )
    )
    for stamp in ("created_at", "updated_at"):
        if stamp not in out.columns:
            out = out.withColumn(stamp, F.current_timestamp())
    return out


def list_ports(ports: DataFrame, keyword: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """Ports whose name contains ``keyword`` (any case), newest first, one page, with ``total``."""
    hit = ports if not keyword else ports.where(F.contains(F.lower("name"), F.lit(keyword.lower())))
    page_rows = hit.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * page_size).limit(page_size)
    return page_rows.withColumn("total", hit.agg(F.count("*")).scalar())
