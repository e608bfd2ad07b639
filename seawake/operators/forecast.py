"""Forecasts and their errors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.functions.geo import add_seconds, hav_m, seconds_between
from seawake.operators.samples import OBS_LEN
from seawake.operators.trips import ordered_points
from seawake.plans.groups import whole_groups
from seawake.plans.joins import spread


def forecast_linear(
    points: DataFrame, duration_min: float = 60, step_min: float = 5, n: int = 10, mmsi: int | None = None
) -> DataFrame:
    """M9: straight-line forecast from a least-squares fit of the last ``n`` reports.

    ``row_number() <= n`` is a group limit in Spark: each task passes on at most ``n`` rows of a
    vessel before the shuffle.
    """
    p = ordered_points(points, mmsi=mmsi)
    w = W.partitionBy("mmsi").orderBy(F.desc("base_date_time"))
    last = p.select("mmsi", "base_date_time", "longitude", "latitude").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    t_end = F.max("base_date_time").over(W.partitionBy("mmsi"))
    rel = last.withColumn("t_end", t_end).withColumn("x", seconds_between("t_end", "base_date_time"))
    fit = (
        rel.groupBy("mmsi", "t_end")
        .agg(
            F.count("*").alias("n_used"),
            F.regr_slope("longitude", "x").alias("slope_lon"),
            F.regr_intercept("longitude", "x").alias("lon0"),
            F.regr_slope("latitude", "x").alias("slope_lat"),
            F.regr_intercept("latitude", "x").alias("lat0"),
        )
        .where("n_used >= 2")
    )
    steps = max(int(duration_min // step_min), 1)
    ahead = F.col("step") * F.lit(float(step_min * 60))
    return fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        "mmsi",
        "step",
        add_seconds(F.col("t_end"), ahead).alias("ts"),
        (F.col("lon0") + F.col("slope_lon") * ahead).alias("lon"),
        (F.col("lat0") + F.col("slope_lat") * ahead).alias("lat"),
    )


def _follow(batches):
    """Tracks from the weighted mean movement of each query's references; rows ordered by query."""
    for t, borders in whole_groups(batches, ["query_id"]):
        w, x0, y0, conf = (t[c].to_numpy() for c in ("w", "x0", "y0", "confidence"))
        ids, steps, lons, lats = [], [], [], []
        ends = t["lons"].chunk(0).offsets.to_numpy()
        x, y = (t[c].chunk(0).values.to_numpy(zero_copy_only=False).astype("float64") for c in ("lons", "lats"))
        for lo, hi in zip(borders[:-1], borders[1:]):
            long = max(int((ends[lo + 1 : hi + 1] - ends[lo:hi]).max()) - 1, 0)
            dx, dy, total = np.zeros(long), np.zeros(long), np.zeros(long)
            for r in range(lo, hi):
                part, n = slice(ends[r], ends[r + 1]), max(ends[r + 1] - ends[r] - 1, 0)
                dx[:n] += np.diff(x[part]) * w[r]
                dy[:n] += np.diff(y[part]) * w[r]
                total[:n] += w[r]
            ids.append(np.full(long, lo))
            steps.append(np.arange(1, long + 1, dtype="int32"))
            lons.append(x0[lo] + np.cumsum(dx / total))
            lats.append(y0[lo] + np.cumsum(dy / total))
        at = np.concatenate(ids)
        yield pa.RecordBatch.from_arrays(
            [t["query_id"].chunk(0).take(pa.array(at)), *[pa.array(np.concatenate(c)) for c in (steps, lons, lats)], pa.array(conf[at])],
            ["query_id", "step", "lon", "lat", "confidence"],
        )


def forecast_retrieval(
    samples: DataFrame, queries: DataFrame, neighbours: DataFrame, k: int = 5, id_col: str = "global_traj_id"
) -> DataFrame:
    """The mean movement of the most similar past tracks, from the query's last position.

    ``samples`` are stored samples (``build_samples``).  ``neighbours`` is the answer of ``similar_tracks`` for ``queries`` (``query_id``, ``obs``).  Each
    reference adds the steps of its ``pred`` part; fewer than ``k`` are filled up with the last
    one, none with the query's own movement.  ``confidence`` is found / k within [0.1, 1].

    A reference travels as one row of two lists of floats; its steps are added up in the task that has all
    references of the query, so single steps are neither shuffled nor ordered.
    """
    def path(before: Column, seq: Column) -> list[Column]:
        axis = lambda a: F.concat(F.array(before[a]), F.transform(seq, lambda p: p[a]))
        return [axis("lon").alias("lons"), axis("lat").alias("lats")]

    found = neighbours.groupBy("query_id").agg(F.count("*").alias("n_refs"), F.max("rank").alias("last_rank"))
    start = F.element_at("obs", -1)
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce("n_refs", F.lit(0)) / k))
    ends = [start["lon"].cast("double").alias("x0"), start["lat"].cast("double").alias("y0"), confidence.alias("confidence")]
    q = queries.select("query_id", "obs").join(found, "query_id", "left")
    base = q.where("n_refs > 0").select("query_id", "n_refs", "last_rank", *ends)
    # each reference counts once, the last one also for every missing place
    weight = F.when(F.col("rank") == F.col("last_rank"), k - F.col("n_refs") + 1).otherwise(1)
    row = ["query_id", "rank", "w", "x0", "y0", "confidence", "lons", "lats"]
    asked = neighbours.select("query_id", "rank", id_col).join(base, "query_id").withColumn("w", weight.cast("double"))
    refs = asked.join(samples.select(id_col, *path(start, F.col("pred"))), id_col).select(row)
    alone = q.where("n_refs is null").select("query_id", F.lit(1).cast(asked.schema["rank"].dataType).alias("rank"), F.lit(1.0).alias("w"), *ends, *path(F.col("obs")[0], F.col("obs")))
    tracks = spread(refs.unionByName(alone.select(row)), ["query_id"]).sortWithinPartitions("query_id", "rank").drop("rank")
    kind = queries.schema["query_id"].dataType.simpleString()
    return tracks.mapInArrow(_follow, f"query_id {kind}, step int, lon double, lat double, confidence double")


def align_reference(obs: DataFrame, length: int = OBS_LEN) -> DataFrame:
    """Cut an array column ``disp`` of (d_lon, d_lat) to ``length`` or fill it up with zeros."""
    zero = F.struct(F.lit(0.0).alias("d_lon"), F.lit(0.0).alias("d_lat"))
    fill = F.array_repeat(zero, F.greatest(F.lit(length) - F.size("disp"), F.lit(0)))
    return obs.withColumn("disp", F.slice(F.concat("disp", fill), 1, length))


def forecast_errors(pred: DataFrame, truth: DataFrame, horizons: Sequence[int] = (120, 240, 360)) -> DataFrame:
    """M11 per track: mean and final error in degrees and km, mean over horizons, true displacement.

    Both frames have ``query_id, step, lon, lat`` with steps from 1, one row per track and step.
    """
    # both sides meet in one shuffle by track, which then serves the sums over its steps as well
    given = lambda df, side: df.select("query_id", F.col("step").cast("int").alias("step"), F.lit(side).alias("side"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    both = spread(given(pred, 0).unionByName(given(truth, 1)), ["query_id"])
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    m = both.groupBy("query_id", "step").agg(
        of(0, "lon").alias("lon"), of(0, "lat").alias("lat"), of(1, "lon").alias("t_lon"), of(1, "lat").alias("t_lat"),
        F.min("side").alias("_s0"), F.max("side").alias("_s1"),
    ).where("_s0 < _s1")
    dx, dy = F.col("lon") - F.col("t_lon"), F.col("lat") - F.col("t_lat")
    m = m.withColumn("deg", F.sqrt(dx * dx + dy * dy)).withColumn("km", hav_m("lon", "lat", "t_lon", "t_lat") / 1000)
    g = m.groupBy("query_id").agg(
        F.avg("deg").alias("ade_deg"),
        F.avg("km").alias("ade_km"),
        F.max_by("deg", "step").alias("fde_deg"),
        *[F.avg(F.when(F.col("step") <= h, F.col("km"))).alias(f"ade_km_{h}") for h in horizons],
        *[end(c, "step").alias(f"{n}_{c}") for end, n in ((F.min_by, "_a"), (F.max_by, "_b")) for c in ("t_lon", "t_lat")],
    )
    return g.select(
        "query_id",
        "ade_deg",
        "ade_km",
        "fde_deg",
        *[f"ade_km_{h}" for h in horizons],
        (hav_m("_a_t_lon", "_a_t_lat", "_b_t_lon", "_b_t_lat") / 1000).alias("true_displacement_km"),
    )


def forecast_metrics(pred: DataFrame, truth: DataFrame, horizons: Sequence[int] = (120, 240, 360)) -> DataFrame:
    """The means of ``forecast_errors`` over all tracks, one row."""
    e = forecast_errors(pred, truth, horizons)
    return e.agg(
        F.count("*").alias("n_tracks"), *[F.avg(c).alias(c) for c in e.columns if c != "query_id"]
    )
