"""From reports to learning samples (M1-M6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.functions.geo import hav_m, seconds, seconds_between
from seawake.operators.trips import segment_points
from seawake.plans.checkpoints import reliable_checkpoint
from seawake.plans.groups import whole_groups
from seawake.plans.joins import fits_broadcast, spread
from seawake.plans.sliced import link_within, running_sum, time_slice
from seawake.sources.sinks import write_samples

# Sampling step and window lengths of the learning data.
STEP_S = 30
OBS_LEN = 120
PRED_LEN = 360
WINDOW_LEN = OBS_LEN + PRED_LEN
STRIDE = 120
MAX_SPEED_KMH = 185.0
MIN_DURATION_S = 4 * 3600

SEGMENT = ["mmsi", "segment_id"]


def _kmh(df: DataFrame) -> DataFrame:
    """Add ``kmh`` of the step to the next row, NULL where no time passes."""
    dt = seconds_between("ts", "next.ts")
    dist = hav_m("lon", "lat", "next.lon", "next.lat")
    return df.withColumn("kmh", F.when(dt > 0, dist / F.nullif(dt, F.lit(0.0)) * 3.6))


def segment_quality(points: DataFrame) -> DataFrame:
    """M1: length, duration and fastest leg per segment, with the verdict ``valid``."""
    return _quality(_kmh(segment_points(points)))


def _quality(s: DataFrame) -> DataFrame:
    return (
        s.groupBy(*SEGMENT)
        .agg(
            F.count("*").alias("n_points"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.max("kmh").alias("max_kmh"),
        )
        .withColumn("duration_s", seconds_between("start_time", "end_time"))
        .withColumn(
            "valid",
            (F.col("n_points") >= 2)
            & (F.col("duration_s") >= MIN_DURATION_S)
            & (F.coalesce("max_kmh", F.lit(0.0)) <= MAX_SPEED_KMH),
        )
    )


def valid_segments(points: DataFrame) -> DataFrame:
    """M1: flat points of segments of at least two points and four hours, without a leg over 185 km/h.

    Segments keep the number they had among all segments of the vessel.
    """
    s = _kmh(segment_points(points))
    good = _quality(s).where("valid").select(*SEGMENT, "n_points", "start_time", "end_time")
    return s.select(*SEGMENT, "ts", "lon", "lat").join(good, SEGMENT)


# --- M2: cubic spline -----------------------------------------------------------

#: knots solved together, and knots added on both sides.  A cubic spline forgets a knot
#: at a rate of about 0.27 per knot, so 64 knots away its influence is far below
#: one unit in the last place: block results equal the spline through all knots.
BLOCK_KNOTS = 4096
HALO_KNOTS = 64


def not_a_knot_slopes(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """First derivatives at the knots of the cubic spline with not-a-knot ends (n >= 4)."""
    n = len(t)
    h, d = np.diff(t), np.diff(y) / np.diff(t)
    low, diag, up, rhs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], diag[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    rhs[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    span = h[0] + h[1]
    diag[0], up[0] = h[1], span
    rhs[0] = ((h[0] + 2 * span) * h[1] * d[0] + h[0] ** 2 * d[1]) / span
    span = h[-1] + h[-2]
    diag[-1], low[-1] = h[-2], span
    rhs[-1] = (h[-1] ** 2 * d[-2] + (2 * span + h[-1]) * h[-2] * d[-1]) / span
    for i in range(1, n):
        w = low[i] / diag[i - 1]
        diag[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    s = np.empty(n)
    s[-1] = rhs[-1] / diag[-1]
    for i in range(n - 2, -1, -1):
        s[i] = (rhs[i] - up[i] * s[i + 1]) / diag[i]
    return s


def spline_values(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (t, y) at ``at``; the last piece extends beyond the end."""
    s = not_a_knot_slopes(t, y)
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = t[i + 1] - t[i]
    u = (at - t[i]) / h
    return (
        (1 + 2 * u) * (1 - u) ** 2 * y[i]
        + u * (1 - u) ** 2 * h * s[i]
        + u**2 * (3 - 2 * u) * y[i + 1]
        + u**2 * (u - 1) * h * s[i + 1]
    )


def _resample_block(step_s: int, block_knots: int):
    def run(knots: pa.Table) -> pa.Table:
        knots = knots.sort_by("idx")
        one = knots.slice(0, 1).to_pylist()[0]
        t, idx = knots["sec"].to_numpy(), knots["idx"].to_numpy()
        t0, n, lo = one["t0"], one["n_points"], one["block"] * block_knots
        hi = lo + block_knots
        # grid points from the first knot of the block up to the first knot of the next
        begin = int(t[idx == lo][0])
        end = one["t1"] + step_s if hi >= n else int(t[idx == hi][0])
        k = np.arange(-(-(begin - t0) // step_s), -(-(end - t0) // step_s))
        at = t0 + k * step_s
        x, u = (t - t[0]).astype("float64"), (at - t[0]).astype("float64")
        return pa.table(
            {
                "mmsi": pa.array(np.full(len(k), one["mmsi"], "int64")),
                "segment_id": pa.array(np.full(len(k), one["segment_id"], "int64")),
                "k": pa.array(k.astype("int64")),
                "ts": pa.array(at.astype("int64") * 1_000_000, pa.timestamp("us", "UTC")),
                "lon": pa.array(spline_values(x, knots["lon"].to_numpy(), u)),
                "lat": pa.array(spline_values(x, knots["lat"].to_numpy(), u)),
            }
        )

    return run


def spline_resample(segments: DataFrame, step_s: int = STEP_S, block_knots: int = BLOCK_KNOTS) -> DataFrame:
    """M2: valid segments on a regular grid of ``step_s`` seconds by a cubic spline.

    Needs at least four points and 480 grid points; the grid may pass the last report by less
    than one step.  Long segments are solved in overlapping blocks (see ``HALO_KNOTS``), so
    no segment has to fit one task.  ``k`` is the grid index in the segment.
    """
    sec = F.floor(seconds("ts"))
    t0, t1 = F.floor(seconds("start_time")), F.floor(seconds("end_time"))
    s = (
        segments.withColumn("sec", sec)
        .withColumn("t0", t0)
        .withColumn("t1", t1)
        .where(F.col("n_points") >= 4)
        .where(F.ceil((F.col("t1") - F.col("t0") + step_s) / step_s) >= WINDOW_LEN)
    )
    s = running_sum(s, SEGMENT, ["ts"], {"_n": F.lit(1)}, time_slice("ts")).withColumn("idx", F.col("_n") - 1)
    own = F.floor(F.col("idx") / block_knots)
    first = F.floor((F.col("idx") - HALO_KNOTS) / block_knots)
    last = F.floor((F.col("idx") + HALO_KNOTS) / block_knots)
    top = F.floor((F.col("n_points") - 1) / block_knots)
    blocks = F.sequence(F.greatest(F.least(first, own), F.lit(0)), F.least(F.greatest(last, own), top))
    s = s.select(*SEGMENT, "idx", "sec", "t0", "t1", "n_points", "lon", "lat", F.explode(blocks).alias("block"))
    keys = [*SEGMENT, "block"]
    return spread(s, keys).groupBy(*keys).applyInArrow(
        _resample_block(step_s, block_knots), "mmsi long, segment_id long, k long, ts timestamp, lon double, lat double"
    )


def filter_resampled(resampled: DataFrame, max_kmh: float = MAX_SPEED_KMH, step_s: int = STEP_S) -> DataFrame:
    """M3: drop segments with any grid step faster than ``max_kmh``; ``step_s`` is the step of the grid.

    The fast segments are found first and written; the grid itself is then neither ordered nor, where they are few,
    shuffled.
    """
    # all steps have one length: a neighbour is never farther than the longest of them
    linked = link_within(resampled.select(*SEGMENT, "ts", "lon", "lat"), SEGMENT, "ts", ["ts", "lon", "lat"], step_s, slices=480)
    bad = reliable_checkpoint(_kmh(linked).where(F.col("kmh") > max_kmh).select(*SEGMENT).distinct())
    few = fits_broadcast(bad)
    return resampled.join(bad.hint("broadcast" if few else "shuffle_hash"), SEGMENT, "left_anti")


#: windows of a segment that are cut in one group
CHUNK_WINDOWS = 64


def _cut_windows(size: int, obs_len: int, stride: int):
    """Windows of grid points ordered by segment, chunk and ``k``, group by group."""

    def cut(t: pa.Table, borders: np.ndarray) -> pa.RecordBatch:
        k, chunk, ts = (t[c].to_numpy() for c in ("k", "chunk", "us"))
        end = np.repeat(borders[1:], np.diff(borders))  # end of each row's group
        own = (k % stride == 0) & (k // (stride * CHUNK_WINDOWS) == chunk)
        i = np.flatnonzero(own & (np.arange(len(k)) + size <= end))
        i = i[k[i + size - 1] == k[i] + size - 1]
        at = i[:, None] + np.arange(size)
        us = ts[at]

        def lists(values: pa.Array, n: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype="int32") * n), values)

        def track(part: np.ndarray) -> pa.Array:
            sides = [pa.array(t[c].to_numpy()[part].ravel()) for c in ("lat", "lon")]
            return lists(pa.StructArray.from_arrays(sides, ["lat", "lon"]), part.shape[1])

        sec = pa.array((us[:, :obs_len] // 1_000_000).ravel())
        start = pa.array(us.min(axis=1)).cast(pa.timestamp("us", "UTC"))
        keys = [t[c].combine_chunks().take(pa.array(i)) for c in SEGMENT]
        columns = [*keys, start, track(at[:, :obs_len]), track(at[:, obs_len:]), lists(sec, obs_len)]
        return pa.RecordBatch.from_arrays(columns, [*SEGMENT, "start_time", "obs", "pred", "obs_time"])

    def run(batches):
        for t, borders in whole_groups(batches, [*SEGMENT, "chunk"]):
            out = cut(t, borders)
            if out.num_rows:
                yield out

    return run


def sliding_samples(
    resampled: DataFrame, obs_len: int = OBS_LEN, pred_len: int = PRED_LEN, stride: int = STRIDE
) -> DataFrame:
    """M4: windows of ``obs_len + pred_len`` grid points, one every ``stride``.

    Expects ``mmsi, segment_id, k, ts, lon, lat`` with ``k`` = 0, 1, 2, … per segment.  A segment is cut into
    chunks of ``CHUNK_WINDOWS`` windows; the points its last windows share with the next chunk are copied, all
    others are shuffled once.  Windows are then cut from points in order, so a task holds one chunk at a time.
    """
    size = obs_len + pred_len
    width = stride * CHUNK_WINDOWS
    own = F.floor(F.col("k") / width)
    lowest = F.greatest(F.least(F.floor((F.col("k") + (stride - size)) / width), own), F.lit(0))
    p = resampled.where("k >= 0").select(
        *SEGMENT, F.explode(F.sequence(lowest, own)).alias("chunk"), F.col("k").cast("long").alias("k"), F.unix_micros("ts").alias("us"),
        F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"),
    )
    keys = [*SEGMENT, "chunk"]
    kinds = ", ".join(f"{c} {p.schema[c].dataType.simpleString()}" for c in SEGMENT)
    track = "array<struct<lat: float, lon: float>>"
    return spread(p, keys).sortWithinPartitions(*keys, "k").mapInArrow(
        _cut_windows(size, obs_len, stride), f"{kinds}, start_time timestamp, obs {track}, pred {track}, obs_time array<long>"
    )


def with_global_id(samples: DataFrame, block: int = 100_000) -> DataFrame:
    """M5: ``global_traj_id`` 0, 1, 2, … in (mmsi, segment, start) order.

    Offsets are added up over three levels (MMSI blocks, vessels, samples of a vessel by segment and
    day), so nothing larger than a block of counts is ordered in one place.  All come from one table of counts
    that is written; the samples are read once more, to be ranked inside a segment's day.
    """
    from pyspark.sql.window import Window as W

    before = lambda c, *part: F.coalesce(F.sum("n").over(W.partitionBy(*part).orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    day = [*SEGMENT, "_day"]
    dated = samples.withColumn("_day", time_slice("start_time", 86_400))
    days = reliable_checkpoint(dated.groupBy(*day).agg(F.count("*").alias("n")))
    per_vessel = days.groupBy("mmsi").agg(F.sum("n").alias("n")).withColumn("blk", F.floor(F.col("mmsi") / block))
    # at most 9000 blocks of nine-digit numbers
    blocks = per_vessel.groupBy("blk").agg(F.sum("n").alias("n")).select("blk", before("blk", F.lit(0)).alias("b0"))
    vessels = per_vessel.withColumn("v0", before("mmsi", "blk")).join(blocks, "blk").select("mmsi", (F.col("b0") + F.col("v0")).alias("_base"))
    order = F.struct("segment_id", "_day")
    offsets = days.withColumn("d0", before(order, "mmsi")).join(vessels, "mmsi").select(*day, (F.col("_base") + F.col("d0")).alias("_base"))
    rank = F.row_number().over(W.partitionBy(*day).orderBy("start_time"))
    ranked = dated.withColumn("_rank", rank).join(offsets, day)
    return ranked.withColumn("global_traj_id", F.col("_base") + F.col("_rank") - 1).drop("_day", "_base", "_rank")


def samples_from_points(points: DataFrame) -> DataFrame:
    """M1 to M5.

    The spline runs once: the windows are written before they are numbered, because numbering
    reads them several times.
    """
    grid = reliable_checkpoint(spline_resample(valid_segments(points)))
    return with_global_id(reliable_checkpoint(sliding_samples(filter_resampled(grid))))


def build_samples(points: DataFrame, path: str) -> None:
    """M6: reports to stored samples."""
    write_samples(samples_from_points(points), path)
