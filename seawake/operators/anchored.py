"""Greedy anchored stops: a stop lasts until the first report beyond the radius of its first report (the anchor).

Where a stop ends does not depend on what came before its anchor.  So every report has a *pointer*, the first later report
beyond its radius, and the anchors of a run are what the pointers reach from its first report.

A run is cut into blocks of whole hours with about ``block_rows`` reports.  One task per block finds the pointers of its
reports; a tree of boxes over the reports lets a search pass what lies inside the radius.  Pointers that leave
the block are followed from block to block, again by boxes.  Then each block is a table from the reports other
blocks point at (its *entries*) to the entries it points at, and which entries a run really visits is found by
doubling those pointers.  The rounds are logarithmic in the number of blocks, whatever the number of stops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.functions.geo import EARTH_M
from seawake.plans.checkpoints import reliable_checkpoint

_RUN = ["mmsi", "run"]
_BLOCK = [*_RUN, "block"]
#: a box is passed if its farthest corner is inside the radius by this share, more than rounding can hide
SAFE = 1 - 1e-7


def _distance(rlon1, rlat1, rlon2, rlat2):
    a = np.sin((rlat2 - rlat1) / 2) ** 2 + np.cos(rlat1) * np.cos(rlat2) * np.sin((rlon2 - rlon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(a), 1.0))


def _xyz(rlon, rlat):
    """Points of the unit sphere, where boxes bound distances everywhere, also at the poles and 180 degrees."""
    return np.c_[np.cos(rlat) * np.cos(rlon), np.cos(rlat) * np.sin(rlon), np.sin(rlat)]


class Exits:
    """Finds the first report of a block beyond the radius of a given place."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, radius_m: float):
        self.n, self.radius = len(lon), radius_m
        self.lon, self.lat = np.radians(lon), np.radians(lat)
        self.chord = 2 * np.sin(min(radius_m / (2 * EARTH_M), np.pi / 2)) * SAFE
        xyz = _xyz(self.lon, self.lat)
        self.low, self.high = [xyz], [xyz]
        while len(self.low[-1]) > 1:
            self.low.append(np.minimum.reduceat(self.low[-1], np.arange(0, len(self.low[-1]), 2)))
            self.high.append(np.maximum.reduceat(self.high[-1], np.arange(0, len(self.high[-1]), 2)))

    def first(self, start: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """For places (radians) the first report at or behind ``start`` beyond the radius, ``n`` if there is none."""
        at, top = start.copy(), len(self.low) - 1
        xyz, level = _xyz(lon, lat), self._rise(at, top)
        live = np.flatnonzero(at < self.n)
        while len(live):
            p, v = at[live], level[live]
            inside = np.zeros(len(live), bool)
            for height in np.unique(v):
                k = v == height
                if height == 0:
                    inside[k] = _distance(lon[live[k]], lat[live[k]], self.lon[p[k]], self.lat[p[k]]) <= self.radius
                else:
                    x, box = xyz[live[k]], p[k] >> height
                    far = np.maximum(np.abs(x - self.low[height][box]), np.abs(x - self.high[height][box]))
                    inside[k] = (far * far).sum(1) <= self.chord**2
            step = live[inside]
            at[step] = ((at[step] >> level[step]) + 1) << level[step]
            level[step] = self._rise(at[step], top)
            down = live[~inside & (v > 0)]
            level[down] -= 1
            live = live[(inside & (at[live] < self.n)) | (~inside & (v > 0))]
        return np.minimum(at, self.n)

    @staticmethod
    def _rise(at: np.ndarray, top: int) -> np.ndarray:
        """The highest level whose box begins at a report."""
        low_bit = np.where(at > 0, at & -at, 1 << top)
        return np.minimum(np.log2(low_bit).astype(np.int64), top)


def _sorted(table: pa.Table):
    table = table.sort_by("ts")
    ts = table["ts"].cast(pa.int64()).to_numpy()
    return table, ts, table["lon"].to_numpy(), table["lat"].to_numpy()


def _point(radius_m: float):
    """Per report of a block the last anchor of the chain it starts inside the block, and where that one points, if known.

    A chain whose last anchor holds all later reports of the block leaves it: its ``target`` is NULL.
    """

    def run(table: pa.Table) -> pa.Table:
        table, ts, lon, lat = _sorted(table)
        exits = Exits(lon, lat, radius_m)
        n = len(ts)
        pointer = exits.first(np.arange(1, n + 1), exits.lon, exits.lat).tolist()
        last = list(range(n))
        for i in range(n - 1, -1, -1):
            if pointer[i] < n:
                last[i] = last[pointer[i]]
        take = pa.array(last)
        return pa.table({"mmsi": table["mmsi"], "run": table["run"], "block": table["block"], "ts": table["ts"],
                         "anchor": table["ts"].take(take), "alon": table["lon"].take(take), "alat": table["lat"].take(take)})

    return run


def _search(radius_m: float):
    """Anchors that reach a block, and the block's first report beyond each."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        table, ts, lon, lat = _sorted(table)
        found = np.full(asked.num_rows, len(ts))
        if len(ts) and asked.num_rows:
            exits = Exits(lon, lat, radius_m)
            alon, alat = (np.radians(asked[c].to_numpy()) for c in ("alon", "alat"))
            found = exits.first(np.zeros(asked.num_rows, np.int64), alon, alat)
        target = table["ts"].take(pa.array(found, mask=found >= len(ts))) if len(ts) else pa.nulls(asked.num_rows, table["ts"].type)
        columns = {c: asked[c] for c in ("mmsi", "run", "anchor", "alon", "alat", "block")}
        return pa.table({**columns, "target": target})

    return run


def _split(radius_m: float):
    """The parts of stops in a block: rows before the entry belong to the anchor that holds over the border."""

    def run(plan: pa.Table, table: pa.Table) -> pa.Table:
        table, ts, lon, lat = _sorted(table)
        carried, entry = plan["carried"][0].as_py(), plan["entry"].cast(pa.int64())[0].as_py()
        start = len(ts) if entry is None else int(np.searchsorted(ts, entry))
        cuts, anchors = [], []
        if start > 0:
            cuts.append((0, start))
            anchors.append(carried)
        if start < len(ts):
            exits = Exits(lon, lat, radius_m)
            i = start
            while i < len(ts):
                j = int(exits.first(np.array([i + 1]), exits.lon[i : i + 1], exits.lat[i : i + 1])[0])
                cuts.append((i, j))
                anchors.append(table["ts"][i].as_py())
                i = j
        n = len(cuts)
        kind = table["ts"].type
        sums = [[float(x[a:b].sum()) for a, b in cuts] for x in (lon, lat)]
        return pa.table({
            "mmsi": pa.array([table["mmsi"][0].as_py()] * n, pa.int64()), "run": pa.array([table["run"][0].as_py()] * n, pa.int64()),
            "anchor": pa.array(anchors, kind), "end_time": table["ts"].take(pa.array([b - 1 for _, b in cuts], pa.int64())),
            "x": pa.array(sums[0], pa.float64()), "y": pa.array(sums[1], pa.float64()), "n": pa.array([b - a for a, b in cuts], pa.int64()),
        })

    return run


def with_blocks(runs: DataFrame, block_rows: int) -> DataFrame:
    """Adds ``block``: whole hours of a run, a new block begins once ``block_rows`` reports have gone by."""
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour")
    hours = runs.groupBy(*_RUN, hour).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(*_RUN).orderBy("hour")) - F.col("n")
    numbered = hours.select(*_RUN, "hour", F.floor(before / block_rows).alias("block"))
    dense = F.dense_rank().over(W.partitionBy(*_RUN).orderBy("block")).cast("long") - 1  # an hour may hold several blocks' reports
    numbered = numbered.withColumn("block", dense)
    return runs.withColumn("hour", hour).join(numbered, [*_RUN, "hour"]).drop("hour")


def anchored_stops(runs: DataFrame, radius_m: float, block_rows: int) -> DataFrame:
    """``mmsi, start_time, end_time, lon, lat, n_points`` of all stops of two or more reports.

    ``runs`` has ``mmsi, run, ts, lon, lat`` and may hold runs of any length.
    """
    reports = reliable_checkpoint(with_blocks(runs.select(*_RUN, "ts", "lon", "lat"), block_rows))
    schema = "mmsi long, run long, block long, ts timestamp, anchor timestamp, alon double, alat double"
    links = reliable_checkpoint(reports.groupBy(*_BLOCK).applyInArrow(_point(radius_m), schema))

    # where the last anchors of all chains point: block by block, past those whose box lies inside the radius
    later = _block_boxes(reports)
    asked = links.select(*_RUN, "block", "anchor", "alon", "alat").distinct()
    known: list[DataFrame] = []
    while True:
        ahead = asked.join(later, _RUN).withColumn("block", _next_block(radius_m)).drop("boxes")
        ahead = reliable_checkpoint(ahead)
        known.append(ahead.where("block is null").select(*_RUN, "anchor", F.lit(None).cast("timestamp").alias("target"), F.lit(None).cast("long").alias("tblock")))
        ahead = ahead.where("block is not null")
        if ahead.isEmpty():
            break
        columns = "mmsi long, run long, anchor timestamp, alon double, alat double, block long, target timestamp"
        seen = ahead.groupBy(*_BLOCK).cogroup(reports.groupBy(*_BLOCK)).applyInArrow(_search(radius_m), columns)
        seen = reliable_checkpoint(seen)
        known.append(seen.where("target is not null").select(*_RUN, "anchor", "target", F.col("block").alias("tblock")))
        asked = seen.where("target is null").drop("target")
    targets = known[0]
    for k in known[1:]:
        targets = targets.unionByName(k)
    targets = reliable_checkpoint(targets)

    # from entry to entry, and which entries a run visits
    starts = reports.groupBy(*_RUN).agg(F.min("ts").alias("ts"))
    entries = targets.where("target is not null").select(*_RUN, F.col("target").alias("ts")).unionByName(starts).distinct()
    steps = entries.join(links.select(*_BLOCK, "ts", "anchor"), [*_RUN, "ts"]).join(targets, [*_RUN, "anchor"])
    steps = reliable_checkpoint(steps.select(*_BLOCK, "ts", "anchor", "target", "tblock"))
    visited = reliable_checkpoint(_visited(starts, steps.select(*_RUN, "ts", "target")))
    path = reliable_checkpoint(steps.join(visited, [*_RUN, "ts"]))

    # each block: the anchor that holds over its border, and the entry where that one's stop ends
    ends = reports.groupBy(*_RUN).agg(F.max("block").alias("most"))
    over = path.join(ends, _RUN).withColumn("next", F.explode_outer(F.when(
        F.col("block") < F.coalesce("tblock", "most"), F.sequence(F.col("block") + 1, F.coalesce("tblock", "most"))
    )))
    over = over.where("next is not null").select(
        *_RUN, F.col("next").alias("block"), F.col("anchor").alias("carried"), F.when(F.col("next") == F.col("tblock"), F.col("target")).alias("entry")
    )
    first = starts.withColumn("block", F.lit(0).cast("long")).select(*_BLOCK, F.lit(None).cast("timestamp").alias("carried"), F.col("ts").alias("entry"))
    plan = over.unionByName(first)
    parts = "mmsi long, run long, anchor timestamp, end_time timestamp, x double, y double, n long"
    parts = plan.groupBy(*_BLOCK).cogroup(reports.groupBy(*_BLOCK)).applyInArrow(_split(radius_m), parts)
    stops = parts.groupBy(*_RUN, "anchor").agg(F.max("end_time").alias("end_time"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n_points"))
    return stops.where("n_points > 1").select(
        "mmsi", F.col("anchor").alias("start_time"), "end_time", (F.col("x") / F.col("n_points")).alias("lon"), (F.col("y") / F.col("n_points")).alias("lat"), "n_points"
    )


def _block_boxes(reports: DataFrame) -> DataFrame:
    """Per run the boxes of its blocks on the unit sphere, in order: one entry for many reports."""
    rlon, rlat = F.radians("lon"), F.radians("lat")
    axes = {"x": F.cos(rlat) * F.cos(rlon), "y": F.cos(rlat) * F.sin(rlon), "z": F.sin(rlat)}
    sides = [f(v).alias(f"{n}{s}") for n, v in axes.items() for f, s in ((F.min, 0), (F.max, 1))]
    boxes = reports.groupBy(*_BLOCK).agg(*sides)
    entry = F.struct("block", *[f"{n}{s}" for n in axes for s in (0, 1)])
    return boxes.groupBy(*_RUN).agg(F.sort_array(F.collect_list(entry)).alias("boxes"))


def _next_block(radius_m: float):
    """The first later block that is not wholly inside the radius of an anchor, NULL if there is none."""
    rlon, rlat = F.radians("alon"), F.radians("alat")
    at = {"x": F.cos(rlat) * F.cos(rlon), "y": F.cos(rlat) * F.sin(rlon), "z": F.sin(rlat)}
    chord = float((2 * np.sin(min(radius_m / (2 * EARTH_M), np.pi / 2)) * SAFE) ** 2)

    def open_(b):
        far = [F.greatest(F.abs(v - b[f"{n}0"]), F.abs(v - b[f"{n}1"])) for n, v in at.items()]
        return (b["block"] > F.col("block")) & (far[0] * far[0] + far[1] * far[1] + far[2] * far[2] > chord)

    return F.get(F.filter("boxes", open_), 0)["block"]


def _visited(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """The entries reached from the first reports: each round doubles how far the pointers jump."""
    reached, jump = starts.select(*_RUN, "ts"), reliable_checkpoint(steps.where("target is not null"))
    while not jump.isEmpty():
        new = reached.join(jump, [*_RUN, "ts"]).select(*_RUN, F.col("target").alias("ts"))
        reached = reliable_checkpoint(reached.unionByName(new).distinct())
        far = jump.select(*_RUN, F.col("ts").alias("target"), F.col("target").alias("far"))
        jump = reliable_checkpoint(jump.join(far, [*_RUN, "target"]).select(*_RUN, "ts", F.col("far").alias("target")))
    return reached
