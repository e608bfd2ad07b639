"""Track simplification.

The split point of a stretch (its farthest report from the chord) does not depend
on the tolerance.  Each report therefore has one *level*: the smallest split distance on
the way down to it.  It is kept at tolerance e exactly if its level exceeds e, so one
pass serves every tolerance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.operators.hulls import LEAF_ROWS, cuts_and_pieces, distances, every_report, hull_corners, rows_of_pieces
from seawake.operators.trips import ordered_points
from seawake.plans.checkpoints import reliable_checkpoint
from seawake.plans.joins import sized_broadcast, spread
from seawake.schema import M_PER_DEGREE

#: stretches up to this many reports go to one Arrow task
STRETCH_ROWS = 100_000
#: reports, or corners of leaves, of one stretch that one task descends through (some 60 bytes each)
MAX_CORNERS = 4_000_000

_SCHEMA = "mmsi long, ts timestamp, lon double, lat double, level double"


def _levels(floor_deg: float):
    """Levels of the inner reports of one stretch, down to ``floor_deg``."""

    def run(stretch: pa.Table) -> pa.Table:
        stretch = stretch.sort_by("ts")
        x, y = stretch["lon"].to_numpy(), stretch["lat"].to_numpy()
        level = np.full(len(x), -1.0)
        todo = [(0, len(x) - 1, stretch["cap"][0].as_py())]
        while todo:
            a, b, cap = todo.pop()
            if b - a < 2:
                continue
            d = distances(x[a + 1 : b], y[a + 1 : b], x[a], y[a], x[b], y[b])
            k = int(np.argmax(d))
            if d[k] > floor_deg:
                m = a + 1 + k
                level[m] = cap = min(cap, float(d[k]))
                todo += [(a, m, cap), (m, b, cap)]
        keep = np.flatnonzero(level >= 0)
        return stretch.select(["mmsi", "ts", "lon", "lat"]).take(keep).append_column("level", pa.array(level[keep]))

    return run


def _chord_distance(a: Column, b: Column, x: Column, y: Column) -> Column:
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    length = F.sqrt(dx * dx + dy * dy)
    off = F.abs(dy * x - dx * y + b["lon"] * a["lat"] - b["lat"] * a["lon"])
    ex, ey = x - a["lon"], y - a["lat"]
    return F.when(length == 0, F.sqrt(ex * ex + ey * ey)).otherwise(off / F.nullif(length, F.lit(0.0)))


def _split_once(rows: DataFrame, keys: list[str], floor_deg: float) -> DataFrame:
    """The first cut of each stretch and its two halves, as ``cuts_and_pieces`` gives them, by combining aggregates."""
    at = F.struct("ts", "lon", "lat")
    chord = rows.groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    d = rows.join(sized_broadcast(chord), keys)
    inner = (F.col("ts") > F.col("a.ts")) & (F.col("ts") < F.col("b.ts"))
    dist = _chord_distance(F.col("a"), F.col("b"), F.col("lon"), F.col("lat"))
    far = d.where(inner).groupBy(*keys).agg(
        F.min(F.struct((-dist).alias("neg"), "ts", "lon", "lat", "cap")).alias("m"),
        F.first("a.ts").alias("t0"),
        F.first("b.ts").alias("t1"),
    )
    far = far.where(-F.col("m.neg") > floor_deg)

    def piece(kind: str, a: str, b: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))

    pieces = F.array(piece("cut", "m.ts", "m.ts"), piece("open", "t0", "m.ts"), piece("open", "m.ts", "t1"))
    level = F.least(F.col("m.cap"), -F.col("m.neg")).alias("level")
    return far.select(*keys, level, F.col("m.lon").alias("lon"), F.col("m.lat").alias("lat"), F.explode(pieces).alias("p")).select(
        *keys, "p.kind", "level", "p.a", "p.b", "lon", "lat"
    )


def split_levels(
    points: DataFrame, floor_m: float, start=None, end=None, mmsi: int | None = None, stretch_rows: int = STRETCH_ROWS,
    max_corners: int = MAX_CORNERS,
) -> DataFrame:
    """``mmsi, ts, lon, lat, level`` of every report kept at ``floor_m``; end points have no bound.

    A track longer than ``stretch_rows`` is first split on hulls (``operators/hulls.py``) into pieces of that size: in one round
    up to ``max_corners`` reports, however deep the splits, and in some more beyond.  Neither ``stretch_rows`` nor
    ``max_corners`` changes the result, but for distances that differ by rounding only.
    """
    floor_deg = floor_m / M_PER_DEGREE
    pts = ordered_points(points, start, end, mmsi=mmsi).select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
    )
    ends = (
        pts.groupBy("mmsi")
        .agg(F.min(F.struct("ts", "lon", "lat")).alias("a"), F.max(F.struct("ts", "lon", "lat")).alias("b"))
        .select("mmsi", F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))
        .select("mmsi", "p.*", F.lit(float("inf")).alias("level"))
    )
    keys = ["mmsi", "stretch"]
    todo = pts.withColumn("stretch", F.lit(0).cast("long")).withColumn("cap", F.lit(float("inf")))
    small, found = todo, [ends]
    # no vessel with that many reports, no long track: settle that on a cheap count first
    n_rows = F.count("*").alias("n")
    if not points.groupBy("mmsi").agg(n_rows).where(F.col("n") > stretch_rows).isEmpty():
        rows = reliable_checkpoint(todo)
        big = sized_broadcast(rows.groupBy(*keys).agg(n_rows).where(F.col("n") > stretch_rows).select(*keys))
        small = rows.join(big, keys, "left_anti")
        rows = rows.join(big, keys, "left_semi")
        while not rows.isEmpty():
            sizes = rows.groupBy(*keys).agg(n_rows)
            large = sized_broadcast(reliable_checkpoint(sizes.where(F.col("n") > max_corners).select(*keys)))
            corners = every_report(rows.join(large, keys, "left_anti"))
            many = large
            if not large.isEmpty():
                hulls = reliable_checkpoint(hull_corners(rows.join(large, keys, "left_semi"), LEAF_ROWS))
                # still too many: such a stretch is split once by an aggregate
                many = hulls.groupBy(*keys).agg(n_rows).where(F.col("n") > max_corners).select(*keys)
                many = sized_broadcast(reliable_checkpoint(many))
                corners = corners.unionByName(hulls.join(many, keys, "left_anti"))
            pieces = cuts_and_pieces(spread(corners, keys), floor_deg, stretch_rows)
            if not many.isEmpty():
                pieces = pieces.unionByName(_split_once(rows.join(many, keys, "left_semi"), keys, floor_deg))
            pieces = reliable_checkpoint(pieces)
            found.append(pieces.where("kind = 'cut'").select("mmsi", F.col("a").alias("ts"), "lon", "lat", "level"))
            rows = reliable_checkpoint(rows_of_pieces(rows, pieces.where("kind <> 'cut'")))
            small = small.unionByName(rows.where("kind = 'small'").drop("kind"))
            rows = rows.where("kind = 'open'").drop("kind")
    inner = spread(small, keys).groupBy(*keys).applyInArrow(_levels(floor_deg), _SCHEMA)
    for f in found:
        inner = inner.unionByName(f)
    return inner


def _track_sizes(points: DataFrame, start=None, end=None, mmsi: int | None = None) -> DataFrame:
    p = ordered_points(points, start, end, mmsi=mmsi)
    return p.groupBy("mmsi").agg(
        F.count("*").alias("original_points"),
        F.min("longitude").alias("min_lon"),
        F.max("longitude").alias("max_lon"),
        F.min("latitude").alias("min_lat"),
        F.max("latitude").alias("max_lat"),
    )


def simplify(
    points: DataFrame, tolerance_m: float = 100, start=None, end=None, mmsi: int | None = None,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """The reports of each track that remain at ``tolerance_m``."""
    kept = split_levels(points, tolerance_m, start, end, mmsi, stretch_rows)
    return kept.select("mmsi", "ts", "lon", "lat")


def simplify_stats(
    points: DataFrame, tolerance_m: float = 100, start=None, end=None, mmsi: int | None = None
) -> DataFrame:
    """Bounds, point counts and compression in percent per track."""
    return simplify_comparison(points, [tolerance_m], start, end, mmsi).join(
        _track_sizes(points, start, end, mmsi).drop("original_points"), "mmsi"
    )


def simplify_comparison(
    points: DataFrame,
    tolerances_m: Sequence[float] = (50, 100, 200, 500),
    start=None,
    end=None,
    mmsi: int | None = None,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Kept points and compression in percent per track and tolerance."""
    levels = split_levels(points, min(tolerances_m), start, end, mmsi, stretch_rows)
    tol = F.explode(F.array(*[F.lit(float(t)) for t in tolerances_m])).alias("tolerance_m")
    kept = (
        levels.select("mmsi", "level", tol)
        .where(F.col("level") > F.col("tolerance_m") / M_PER_DEGREE)
        .groupBy("mmsi", "tolerance_m")
        .agg(F.count("*").alias("kept_points"))
    )
    n = _track_sizes(points, start, end, mmsi).select("mmsi", "original_points")
    return kept.join(n, "mmsi").withColumn(
        "compression_pct", (1 - F.col("kept_points") / F.col("original_points")) * 100
    )
