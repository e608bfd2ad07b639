"""Spatio-temporal retrieval over trip summaries (R1-R4, R6).  R5 is in ``functions.geo``."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.functions.geo import instant, mbb_intersects, seconds
from seawake.operators import boxes as box_search
from seawake.plans.blocks import against, blocks_for
from seawake.plans.cells import cell_join
from seawake.plans.checkpoints import reliable_checkpoint
from seawake.plans.joins import semi_filter

Box = tuple[float, float, float, float, dt.datetime, dt.datetime]


def box_column(box: Box) -> Column:
    """``(xmin, xmax, ymin, ymax, tmin, tmax)`` as a bounding-box struct."""
    names = ("xmin", "xmax", "ymin", "ymax")
    xy = [F.lit(float(v)).alias(n) for v, n in zip(box[:4], names)]
    return F.struct(*xy, instant(box[4]).alias("tmin"), instant(box[5]).alias("tmax"))


#: boxes tested together on a trip where cells are not used
BLOCK = 1000


def range_query(summaries: DataFrame, boxes: DataFrame, pruned: bool = True) -> DataFrame:
    """Vessels with a trip box meeting each closed query box: ``box_id, mmsi``.

    ``boxes`` has ``box_id`` and ``box``.  With ``pruned`` blocks of vessels and of boxes meet in one task each (``plans.blocks``), which
    searches a tree of the trips' boxes and gives each vessel of a box once: no hit is shuffled to make hits distinct.
    Without, every box is tested on every trip, ``BLOCK`` boxes of one row at a time; that form
    exists to check the first, and its plan is the same for any number of boxes.
    """
    if not pruned:
        return _scan(summaries, boxes)
    s, b = (reliable_checkpoint(df) for df in (summaries.select("mmsi", "mbb"), boxes.select("box_id", "box")))
    kind = boxes.schema["box_id"].dataType.simpleString()
    parts = _parts(_sides(s, "mbb"), _sides(b, "box"), "box_id", kind)
    return parts.groupBy("part").applyInArrow(box_search.hits("box_id"), f"box_id {kind}, mmsi long")


#: trips of a block, whose tree a task holds, and queries of a block
TRIP_ROWS, QUERY_ROWS = 200_000, 500_000


def _sides(df: DataFrame, box: str) -> DataFrame:
    """Complete boxes as plain numbers, times in microseconds."""
    names = ("xmin", "xmax", "ymin", "ymax", "tmin", "tmax")
    sides = [(F.unix_micros(f"{box}.{n}") if n[0] == "t" else F.col(f"{box}.{n}")).alias(c) for n, c in zip(names, box_search.SIDES)]
    return df.select(*[c for c in df.columns if c != box], *sides).dropna(subset=box_search.SIDES)


def _parts(trips: DataFrame, asked: DataFrame, number: str, kind: str) -> DataFrame:
    """Blocks of vessels against blocks of queries."""
    trips, asked = trips.withColumn(number, F.lit(None).cast(kind)), asked.withColumn("mmsi", F.lit(None).cast("long"))
    return against(trips, "mmsi", blocks_for(trips, 8, 1000, TRIP_ROWS), asked, number, blocks_for(asked, 6, 1000, QUERY_ROWS))


def _scan(summaries: DataFrame, boxes: DataFrame) -> DataFrame:
    """The hits of every box on every trip, the boxes in blocks."""
    blocks = max(1, -(-boxes.count() // BLOCK))
    block = boxes.select(F.pmod(F.xxhash64("box_id"), F.lit(blocks)).alias("block"), F.struct("box_id", "box").alias("q"))
    lists = block.groupBy("block").agg(F.collect_list("q").alias("tests"))
    s = summaries.select("mmsi", "mbb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    hits = s.join(lists, "block").select("mmsi", F.explode(F.filter("tests", lambda q: mbb_intersects(F.col("mbb"), q["box"]))).alias("q"))
    return hits.select("q.box_id", "mmsi").distinct()


def _asked(spark: SparkSession, listed: Sequence[tuple]) -> DataFrame:
    """Query points of a list as a DataFrame."""
    names = ("query_id", "lon", "lat", "ts")
    rows = [
        F.struct(*(c.alias(n) for c, n in zip((F.lit(i), F.lit(float(x)), F.lit(float(y)), instant(t)), names)))
        for i, x, y, t in listed
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("q")).select("q.*")


def _ring(asked: DataFrame, reach: float, hours: int = 1) -> DataFrame:
    """Query points with the box of their ring: ``reach`` degrees and an hour to each side."""
    hour = F.expr(f"interval {hours} hour")
    sides = [(F.col(c) + d * reach).alias(n) for c, d, n in (("lon", -1, "xmin"), ("lon", 1, "xmax"), ("lat", -1, "ymin"), ("lat", 1, "ymax"))]
    return asked.withColumn("box", F.struct(*sides, (F.col("ts") - hour).alias("tmin"), (F.col("ts") + hour).alias("tmax")))


def knn_query(
    summaries: DataFrame, queries: DataFrame | Sequence[tuple], k: int = 10, radius: float = 0.1, max_radius: float = 180.0
) -> DataFrame:
    """R2: the ``k`` nearest vessels to each query point: ``query_id, rank, mmsi, distance``.

    ``queries`` has ``query_id, lon, lat, ts``, or is a list of such tuples.  Candidates are trips within an hour of
    the query whose box meets a square around it; the square doubles from ``radius`` until it holds ``k``
    vessels, and a query that never gets ``k`` keeps those within the largest square.  The distance of a vessel is that of
    its nearest trip within the hour, to the trip's box, in degrees and hours.

    Blocks of vessels and of queries meet in one task each (``plans.blocks``).  It widens the ring of a query until it holds ``k`` of its vessels and
    gives no more than twice ``k`` of them, with the doubling that meets them; the nearest of all blocks are chosen from those.
    """
    spark = summaries.sparkSession
    asked = queries if isinstance(queries, DataFrame) else _asked(spark, queries)
    asked = asked.select("query_id", "lon", "lat", "ts").where("lon is not null and lat is not null and ts is not null").distinct()
    kind = asked.schema["query_id"].dataType.simpleString()
    trips = reliable_checkpoint(summaries.select("mmsi", "mbb").where("mbb is not null"))
    widest = math.floor(math.log2(max_radius / radius))
    parts = _parts(_sides(trips, "mbb"), _sides(reliable_checkpoint(_ring(asked, 0.0, 0).select("query_id", "box")), "box"), "query_id", kind)
    search = box_search.nearest(k, radius, widest)
    found = parts.groupBy("part").applyInArrow(search, f"query_id {kind}, mmsi long, level int, distance double")
    # the ring of the whole fleet is the first that holds k of what the blocks gave
    of_query = W.partitionBy("query_id")
    found = found.withColumn("upto", F.count(F.lit(1)).over(of_query.orderBy("level")))
    stop = F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("level"))).over(of_query), F.lit(widest))
    found = found.withColumn("stop", stop).where(F.col("level") <= F.col("stop"))
    rank = F.row_number().over(of_query.orderBy("distance", "mmsi"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "mmsi", "distance")


def _apart() -> tuple[Column, Column, Column]:
    """Of a trip's box ``mbb`` and a query point: whether they are within an hour, half the square that reaches the box, distance."""
    b, zero = F.col("mbb"), F.lit(0.0)
    t, t0, t1 = seconds("ts"), seconds("mbb.tmin"), seconds("mbb.tmax")
    dx = F.greatest(b["xmin"] - F.col("lon"), zero, F.col("lon") - b["xmax"])
    dy = F.greatest(b["ymin"] - F.col("lat"), zero, F.col("lat") - b["ymax"])
    gap = F.greatest(t0 - t, zero, t - t1) / 3600
    return (t0 <= t + 3600) & (t1 >= t - 3600), F.greatest(dx, dy), F.sqrt(dx * dx + dy * dy + gap * gap)


def _around(trips: DataFrame, asked: DataFrame, radius: float, top: int) -> DataFrame:
    """Per query and vessel in its ring of ``top`` doublings the least doubling that meets it, by cells: a check of ``knn_query``."""
    near_in_time, reach, _ = _apart()
    # the smallest doubling whose square reaches the box, tested on exact powers of two
    level = F.lit(None).cast("int")
    for n in range(top, -1, -1):
        level = F.when(reach <= radius * 2**n, n).otherwise(level)
    c = cell_join(trips, "mbb", _ring(asked, radius * 2**top), "box").where(near_in_time)
    c = c.select("query_id", "mmsi", level.alias("level")).where("level is not null")
    return c.groupBy("query_id", "mmsi").agg(F.min("level").alias("level"))


def vessel_details(summaries: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Summaries of the listed vessels (one id, a list, or a frame with ``mmsi``)."""
    if isinstance(ids, DataFrame):
        return semi_filter(summaries, ids, ["mmsi"])
    return summaries.where(F.col("mmsi").isin(list(ids)))


def st_partition(summaries: DataFrame, n_parts: int = 16) -> DataFrame:
    """``n_parts`` balanced space-time parts: adds ``part``, splitting cells at the median of their widest axis.

    Axes are box centres in degrees and hours.  Each round splits all parts, or the fullest ones if fewer are
    missing, and is one aggregate; what returns to the driver is one row per part.  The parts so far are a tree of
    cuts that rows are sent down by arrays, so neither the plan nor what is stored grows with ``n_parts``.
    There are fewer parts only where no part can be split any more.  Write the result with
    ``partitionBy('part')`` so that range queries skip files.
    """
    if n_parts < 2:
        return summaries.withColumn("part", F.lit(0))
    b = F.col("mbb")
    centre = F.struct(
        ((b["xmin"] + b["xmax"]) / 2).alias("x"),
        ((b["ymin"] + b["ymax"]) / 2).alias("y"),
        ((seconds("mbb.tmin") + seconds("mbb.tmax")) / 7200).alias("t"),
    )
    axes, tree, n, solid = ("x", "y", "t"), CutTree(), 1, set()
    # a round reads three numbers a row, and they must not change between rounds
    centres = reliable_checkpoint(summaries.select(centre.alias("c")).select("c.*"))
    while n < n_parts:
        stats = centres.withColumn("part", tree.part(*axes)).groupBy("part").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.percentile_approx(a, 0.5, 10_000).alias(f"mid_{a}") for a in axes],
            *[F.min(a).alias(f"min_{a}") for a in axes],
            *[F.max(a).alias(f"max_{a}") for a in axes],
        )
        rows = [r for r in stats.collect() if r["part"] not in solid]
        before = n
        for r in sorted(rows, key=lambda r: (-r["n"], r["part"]))[: n_parts - n]:
            axis = max(axes, key=lambda a: r[f"max_{a}"] - r[f"min_{a}"])
            low, mid, high = (float(r[f"{k}_{axis}"]) for k in ("min", "mid", "max"))
            if low == high:
                solid.add(r["part"])
            else:  # a median at the top would leave nothing above it
                tree.split(r["part"], axes.index(axis), mid if mid < high else math.nextafter(high, low), n)
                n += 1
        if n == before:
            break
    return summaries.withColumn("part", tree.part(centre["x"], centre["y"], centre["t"]))


class CutTree:
    """A binary tree of cuts as arrays; leaves are parts, numbered in the order they were made."""

    def __init__(self):
        self.axis, self.cut, self.low, self.high = [-1], [0.0], [0], [0]  # a leaf has axis -1 and its part in ``low``
        self.leaf = {0: 0}

    def split(self, part: int, axis: int, cut: float, new: int) -> None:
        """Rows of ``part`` above ``cut`` become the part ``new``."""
        at, kids = self.leaf[part], (len(self.axis), len(self.axis) + 1)
        self.axis[at], self.cut[at], self.low[at], self.high[at] = axis, cut, *kids
        for number, kid in zip((part, new), kids):
            self.axis.append(-1)
            self.cut.append(0.0)
            self.low.append(number)
            self.high.append(number)
            self.leaf[number] = kid

    def part(self, x: Column | str, y: Column | str, t: Column | str) -> Column:
        axis, cut = np.array(self.axis), np.array(self.cut)
        low, high = np.array(self.low), np.array(self.high)

        @F.pandas_udf("int")
        def of(x: pd.Series, y: pd.Series, t: pd.Series) -> pd.Series:
            v = np.column_stack([x, y, t]).astype(float)
            at, rows = np.zeros(len(v), np.int64), np.arange(len(v))
            while len(rows := rows[axis[at[rows]] >= 0]):
                here = at[rows]
                at[rows] = np.where(v[rows, axis[here]] > cut[here], high[here], low[here])
            return pd.Series(low[at].astype(np.int32))

        return of(x, y, t)
