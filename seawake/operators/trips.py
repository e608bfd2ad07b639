"""Trajectory construction and temporal-point functions.

Trips stay flat.  ``build_trips`` gives one row per instant

    mmsi, vessel_name, trip_key, seq_id, ts, lon, lat, prev, next, slice

where ``prev``/``next`` are ``struct<ts, lon, lat>`` of the adjacent instants of the same
sequence (NULL at its ends).  A leg is therefore one row (this instant to ``next``) and
needs no further join or window.  ``seq_id`` is the only column that depends on the whole
history of a vessel; operators that do not need it ask for ``numbered=False``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.functions.geo import hav_m, in_period, instant, seconds_between
from seawake.plans.joins import spread
from seawake.plans.sliced import asof_within, chain, link_within, number_runs, running_sum, time_slice
from seawake.schema import MS_TO_KNOTS, SEGMENT_GAP_S, TRIP_GAP_S, check_mmsi, check_period
from seawake.sources.sinks import dedupe_points


def ordered_points(points: DataFrame, start=None, end=None, closed: bool = True, mmsi: int | None = None) -> DataFrame:
    """Positioned reports of a period, one per (mmsi, time): the smallest ``src_id`` stays."""
    check_mmsi(mmsi)
    check_period(start, end)
    p = points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    p = p.where(in_period("base_date_time", start, end, closed))
    if mmsi is not None:
        p = p.where(F.col("mmsi") == mmsi)
    return dedupe_points(p, keep="first")


def around_period(points: DataFrame, start, end, gap_s: float = TRIP_GAP_S) -> DataFrame:
    """Reports of a period and ``gap_s`` around it.

    A leg is at most that long, so every leg that touches the period has both its ends here, and
    the bounds reach the scan.
    """
    if start is None:
        return points
    halo = F.make_dt_interval(secs=F.lit(float(gap_s)))
    at = F.col("base_date_time")
    return points.where((at >= instant(start) - halo) & (at <= instant(end) + halo))


def _name_key(name: Column) -> Column:
    """Non-NULL stand-in for a nullable name, so that NULL names group and join."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def build_trips(
    points: DataFrame,
    gap_s: float = TRIP_GAP_S,
    by_name: bool = True,
    mmsi: int | None = None,
    numbered: bool = True,
    start=None,
    end=None,
) -> DataFrame:
    """Trips per (mmsi, vessel_name), or per mmsi when ``by_name`` is false.

    With ``start`` and ``end`` only the legs that touch that period are sure to be complete, and
    reports farther away are not read; sequence numbers need the whole history.

    A new sequence starts at a gap longer than ``gap_s``.  ``by_name=False`` follows
    a vessel through reports with a missing or changed name; ``vessel_name`` is then
    that of the report.
    """
    if start is not None and numbered:
        raise ValueError("sequence numbers need the whole history: use numbered=False with a period")
    p = ordered_points(around_period(points, start, end, gap_s), mmsi=mmsi).select(
        "mmsi",
        *([] if by_name else ["vessel_name"]),
        (_name_key(F.col("vessel_name")) if by_name else F.lit("")).alias("trip_key"),
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
    )
    keys = ["mmsi", "trip_key"] if by_name else ["mmsi"]
    t = link_within(p, keys, "ts", ["ts", "lon", "lat"], gap_s)
    if numbered:
        t = number_runs(t, keys, ["ts"], F.col("prev").isNull(), "seq_id")
    if by_name:
        t = t.withColumn(
            "vessel_name", F.when(F.col("trip_key") != "", F.expr("substring(trip_key, 2)"))
        )
    return t.select("mmsi", "vessel_name", "trip_key", *_seq(t), "ts", "lon", "lat", "prev", "next", "slice")


def _seq(df: DataFrame) -> list[str]:
    return ["seq_id"] if "seq_id" in df.columns else []


def segment_points(points: DataFrame, gap_s: float = SEGMENT_GAP_S, extra: Sequence[str] = ()) -> DataFrame:
    """Flat segments: reports of a vessel numbered by gaps longer than ``gap_s``."""
    p = ordered_points(points).select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        *extra,
    )
    s = link_within(p, ["mmsi"], "ts", ["ts", "lon", "lat"], gap_s)
    return number_runs(s, ["mmsi"], ["ts"], F.col("prev").isNull(), "segment_id")


def collect_ordered(df: DataFrame, keys: Sequence[str], slice_col: str, item: Column, name: str) -> DataFrame:
    """Sorted array of ``item`` per key, assembled slice by slice.

    Each slice is gathered and sorted on its own; the last step only joins sorted runs,
    so the sort of a long track is spread over its slices.
    """
    parts = df.groupBy(*keys, slice_col).agg(F.array_sort(F.collect_list(item)).alias("_part"))
    runs = F.array_sort(F.collect_list(F.struct(F.col(slice_col).alias("s"), F.col("_part").alias("p"))))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(runs, lambda r: r["p"])).alias(name))


SEGMENT_ATTRIBUTES = (
    "sog", "cog", "heading", "vessel_name", "imo", "call_sign", "vessel_type", "status",
    "length", "width", "draft", "cargo", "transceiver",
)


def segment_literal(points: Column) -> Column:
    """Canonical text ``{POINT(lon lat)@time,…}``, six decimals, whole seconds (session zone UTC)."""

    def one(p: Column) -> Column:
        at = F.date_format(p["ts"], "yyyy-MM-dd HH:mm:ss")
        return F.format_string("POINT(%.6f %.6f)@%s+00", p["lon"], p["lat"], at)

    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(points, one)), F.lit("}"))


def build_segments(points: DataFrame, gap_s: float = SEGMENT_GAP_S) -> DataFrame:
    """Segments of at least two points, with points, hash and first-row attributes.

    One segment is one output row, so its points form one array; ``collect_ordered``
    builds it from per-hour runs.
    """
    s = segment_points(points, gap_s, extra=SEGMENT_ATTRIBUTES)
    keys = ["mmsi", "segment_id"]
    first = s.where(F.col("prev").isNull() & F.col("next").isNotNull()).select(*keys, *SEGMENT_ATTRIBUTES)
    tracks = collect_ordered(
        s.where(F.col("prev").isNotNull() | F.col("next").isNotNull()),
        keys,
        "slice",
        F.struct("ts", "lon", "lat"),
        "points",
    )
    return (
        tracks.withColumn("trip_hash", F.md5(segment_literal(F.col("points"))))
        .withColumn("n_points", F.size("points"))
        .join(first, keys)
    )


def explode_segments(segments: DataFrame) -> DataFrame:
    """SRC6: stored segments back to flat points."""
    return segments.select("mmsi", "segment_id", F.explode("points").alias("p")).select(
        "mmsi", "segment_id", "p.ts", "p.lon", "p.lat"
    )


def legs(trip_points: DataFrame) -> DataFrame:
    """Consecutive pairs inside a sequence with duration, distance and speed."""
    g = trip_points.where(F.col("next").isNotNull()).select(
        "mmsi",
        "vessel_name",
        "trip_key",
        *_seq(trip_points),
        "ts",
        F.col("next.ts").alias("ts2"),
        "lon",
        "lat",
        F.col("next.lon").alias("lon2"),
        F.col("next.lat").alias("lat2"),
    )
    g = g.withColumn("dt", seconds_between("ts", "ts2")).withColumn("dist_m", hav_m("lon", "lat", "lon2", "lat2"))
    return g.withColumn("speed_ms", F.col("dist_m") / F.col("dt"))


def clip_legs(leg: DataFrame, start=None, end=None) -> DataFrame:
    """Cut legs to a closed period; adds ``frac`` (share kept) and clipped ends.

    Speed along a leg is constant, so distance scales with ``frac``.
    """
    if start is None:
        return leg.withColumn("frac", F.lit(1.0)).withColumn("t1", F.col("ts")).withColumn("t2", F.col("ts2"))
    s, e = instant(start), instant(end)
    return (
        leg.where((F.col("ts") < e) & (F.col("ts2") > s))
        .withColumn("t1", F.greatest("ts", s))
        .withColumn("t2", F.least("ts2", e))
        .withColumn("frac", seconds_between("t1", "t2") / F.col("dt"))
    )


def lerp(p1: Column, p2: Column, frac: Column) -> Column:
    return p1 + (p2 - p1) * frac


def lerp_lon(p1: Column, p2: Column, frac: Column) -> Column:
    """Between two longitudes the short way round; across 180 degrees the result is wrapped."""
    d = p2 - p1
    over = p1 + (d - 360.0 * F.signum(d)) * frac
    wrapped = over - 360.0 * F.floor((over + 180.0) / 360.0)
    return F.when(F.abs(d) <= 180.0, lerp(p1, p2, frac)).otherwise(wrapped)


def lerp_axis(axis: str):
    return lerp_lon if axis == "lon" else lerp


def at_period(trip_points: DataFrame, start, end, closed: bool = False) -> DataFrame:
    """T4: a trip restricted to a period, with interpolated points at cut ends.

    ``closed=False`` is ``[start, end)``: the limit point at ``end`` still bounds the
    track, as the half-open restriction of a continuous track approaches it.
    """
    check_period(start, end)
    s, e = instant(start), instant(end)
    ts, nxt = F.col("ts"), F.col("next")
    cut = lambda t: F.struct(
        t.alias("ts"),
        lerp_lon(F.col("lon"), nxt["lon"], seconds_between(ts, t) / seconds_between(ts, nxt["ts"])).alias("lon"),
        lerp(F.col("lat"), nxt["lat"], seconds_between(ts, t) / seconds_between(ts, nxt["ts"])).alias("lat"),
        F.lit(True).alias("interpolated"),
    )
    own = F.struct("ts", "lon", "lat", F.lit(False).alias("interpolated"))
    inside = (ts >= s) & ((ts <= e) if closed else (ts < e))
    enters = (ts < s) & (nxt["ts"] > s)
    # at the open end the limit point is added whenever a leg reaches or passes it
    leaves = (ts < e) & ((nxt["ts"] > e) if closed else (nxt["ts"] >= e))
    pieces = F.array_compact(
        F.array(F.when(inside, own), F.when(enters, cut(s)), F.when(leaves, cut(e)))
    )
    return (
        trip_points.where((ts <= e) & (F.coalesce(nxt["ts"], ts) >= s))
        .select("mmsi", "vessel_name", "trip_key", *_seq(trip_points), F.explode(pieces).alias("p"))
        .select("mmsi", "vessel_name", "trip_key", *_seq(trip_points), "p.*")
    )


def track_statistics(points: DataFrame, start=None, end=None, mmsi: int | None = None) -> DataFrame:
    """T5: length, duration, maximum and time-weighted mean speed per vessel in ``[start, end]``.

    One pass over the trips: every instant brings the part of its leg inside the period,
    and the sums combine before the shuffle.
    """
    check_period(start, end)
    t = build_trips(points, mmsi=mmsi, numbered=False, start=start, end=end)
    leg_end = F.coalesce("next.ts", "ts")
    t1, t2 = F.col("ts"), leg_end
    if start is not None:
        s, e = instant(start), instant(end)
        t = t.where((F.col("ts") <= e) & (leg_end >= s))
        t1, t2 = F.greatest(t1, s), F.least(t2, e)
    dt = seconds_between("ts", "next.ts")
    t = (
        t.withColumn("_dist", hav_m("lon", "lat", "next.lon", "next.lat"))
        .withColumn("_dt", dt)
        .withColumn("_in", F.when(F.col("next").isNotNull(), seconds_between(t1, t2)))
    )
    stats = t.groupBy("mmsi").agg(
        F.sum(F.col("_dist") * F.col("_in") / F.col("_dt")).alias("_m"),
        F.sum("_in").alias("_s"),
        F.max(F.when(F.col("_in") > 0, F.col("_dist") / F.col("_dt"))).alias("_vmax"),
    )
    zero = F.lit(0.0)
    return stats.select(
        "mmsi",
        F.coalesce(F.col("_m") / 1000, zero).alias("distance_km"),
        F.coalesce(F.col("_s") / 3600, zero).alias("duration_h"),
        F.coalesce(F.col("_vmax") * MS_TO_KNOTS, zero).alias("max_speed_kn"),
        F.coalesce(F.col("_m") / F.nullif(F.col("_s"), zero) * MS_TO_KNOTS, zero).alias("avg_speed_kn"),
    )


def speed_series(points: DataFrame, start=None, end=None, mmsi: int | None = None) -> DataFrame:
    """Step speed in knots at every instant; the last instant repeats its last leg."""
    check_period(start, end)
    t = build_trips(points, mmsi=mmsi, numbered=False, start=start, end=end).where(in_period("ts", start, end))
    out = F.col("next"), F.col("prev")
    fwd = hav_m("lon", "lat", out[0]["lon"], out[0]["lat"]) / seconds_between("ts", out[0]["ts"])
    back = hav_m(out[1]["lon"], out[1]["lat"], "lon", "lat") / seconds_between(out[1]["ts"], "ts")
    speed = F.when(out[0].isNotNull(), fwd).when(out[1].isNotNull(), back)
    return t.where(out[0].isNotNull() | out[1].isNotNull()).select(
        "mmsi", "vessel_name", "ts", (speed * MS_TO_KNOTS).alias("speed_kn")
    )


def value_at(trip_points: DataFrame, queries: DataFrame, gap_s: float = TRIP_GAP_S) -> DataFrame:
    """Position at each ``(mmsi, ts)`` query, NULL outside a sequence or in a gap.

    Expects vessel-level trips (``by_name=False``) built with the same ``gap_s``.  Each query finds
    the last instant at or before it; the leg from there, at most ``gap_s`` long, holds
    the answer.
    """
    got = asof_within(queries, trip_points, ["mmsi"], "ts", "ts", ["ts", "lon", "lat", "next"], gap_s)
    hit = F.col("hit")
    frac = seconds_between(hit["ts"], "ts") / seconds_between(hit["ts"], hit["next"]["ts"])
    exact = hit["ts"] == F.col("ts")

    def pos(axis: str) -> Column:
        return F.when(exact, hit[axis]).when(hit["next"].isNotNull(), lerp_axis(axis)(hit[axis], hit["next"][axis], frac))

    return got.withColumn("lon", pos("lon")).withColumn("lat", pos("lat")).drop("hit")


def trip_summary(trip_points: DataFrame) -> DataFrame:
    """Start, end, number of instants and bounding box per trip."""
    return (
        trip_points.groupBy("mmsi", "trip_key")
        .agg(
            F.max("vessel_name").alias("vessel_name"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.count("*").alias("n_instants"),
            F.min("lon").alias("xmin"),
            F.max("lon").alias("xmax"),
            F.min("lat").alias("ymin"),
            F.max("lat").alias("ymax"),
        )
        .where(F.col("xmin").isNotNull() & F.col("ymin").isNotNull())
        .withColumn(
            "mbb",
            F.struct("xmin", "xmax", "ymin", "ymax", F.col("start_time").alias("tmin"), F.col("end_time").alias("tmax")),
        )
        .drop("xmin", "xmax", "ymin", "ymax")
    )


def time_range(points: DataFrame, mmsi: int | None = None) -> DataFrame:
    """First and last report and number of reports per vessel."""
    check_mmsi(mmsi)
    p = points if mmsi is None else points.where(F.col("mmsi") == mmsi)
    return p.groupBy("mmsi").agg(
        F.min("base_date_time").alias("start_time"),
        F.max("base_date_time").alias("end_time"),
        F.count("*").alias("n_points"),
    )


def resample_frames(
    points: DataFrame, start, end, step_s: int = 60, mmsi: int | None = None, nth: bool = False
) -> DataFrame:
    """One frame per vessel every ``step_s`` seconds from ``start`` to ``end``.

    Linear between the reports around a frame, whatever the gap; the last report is
    held; nothing before the first.  Reports are linked to the next one, however far, and each gives the
    frames from itself up to that one, so only reports are shuffled and ordered, never frames.
    ``nth`` adds the number of a frame counted from the vessel's first one (0, 1, 2, …).
    """
    check_period(start, end)
    p = ordered_points(points, mmsi=mmsi).select(
        "mmsi",
        F.col("base_date_time").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        "sog",
        "cog",
    )
    s, e = F.unix_micros(instant(start)), F.unix_micros(instant(end))
    step = F.lit(int(step_s * 1_000_000))

    def frame_from(us: Column) -> Column:
        """Number of the first frame at or after a time."""
        return F.ceil(F.greatest(us - s, F.lit(0)) / step)

    # many frames come from few bytes of reports: AQE must not merge their partitions
    sliced = spread(p.withColumn("slice", time_slice("ts")), ["mmsi", "slice"])
    linked = chain(sliced, ["mmsi"], ["ts"], ["ts", "lon", "lat"], F.col("slice"))
    first, none_after = frame_from(F.unix_micros("ts")), F.floor((e - s) / step) + 1
    until = F.when(F.col("next").isNotNull(), frame_from(F.unix_micros("next.ts"))).otherwise(none_after)
    last = F.least(until, none_after) - 1
    linked = linked.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    if nth:
        begin = linked.groupBy("mmsi").agg(F.min("_first").alias("_begin"))
        linked = linked.join(begin, "mmsi")
    got = linked.withColumn("frame", F.explode(F.sequence("_first", "_last")))
    got = got.withColumn("at", F.timestamp_micros(s + F.col("frame") * step))
    ahead = F.col("next")
    frac = seconds_between("ts", "at") / seconds_between("ts", ahead["ts"])
    hold = (F.col("ts") == F.col("at")) | ahead.isNull()

    def pos(axis: str) -> Column:
        return F.when(hold, F.col(axis)).otherwise(lerp_axis(axis)(F.col(axis), ahead[axis], frac))

    return got.select(
        "mmsi",
        F.col("frame").cast("int").alias("frame"),
        F.col("at").alias("ts"),
        pos("lon").alias("lon"),
        pos("lat").alias("lat"),
        F.coalesce("sog", F.lit(0.0)).alias("sog"),
        F.coalesce("cog", F.lit(0.0)).alias("cog"),
        *([(F.col("frame") - F.col("_begin")).alias("nth")] if nth else []),
    )


def frame_trails(frames: DataFrame, n: int = 10, block: int = 1000) -> DataFrame:
    """Each frame with the track of up to ``n`` frames before it and itself.

    Frames are cut into blocks; the last ``n`` frames of a block are copied into
    the next one, so a long animation is not one window partition.
    """
    from pyspark.sql.window import Window as W

    block = max(block, n)  # the frames before one lie in its block or the one ahead
    own = F.floor(F.col("frame") / block)
    late = F.col("frame") % block >= block - n
    halo = frames.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = W.partitionBy("mmsi", "_block").orderBy("frame").rowsBetween(-n, 0)
    return (
        halo.withColumn("trail", F.collect_list(F.struct("ts", "lon", "lat")).over(w))
        .where(F.col("_own") == F.col("_block"))
        .drop("_own", "_block")
    )


def track_lines(points: DataFrame, start=None, end=None, mmsi: int | None = None) -> DataFrame:
    """Track of each vessel in ``[start, end)`` as flat rows ready for ``to_geojson``."""
    trips = build_trips(points, by_name=False, mmsi=mmsi, numbered=False, start=start, end=end)
    return trips if start is None else at_period(trips, start, end)


def resample_arclength(tracks: DataFrame, n: int = 120, order: str = "ts", keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """``n`` points equally spaced along the planar length of each polyline.

    ``tracks`` has the keys, an order column (timestamp or integer) and ``lon``, ``lat``.
    Every leg emits the targets that fall on it, so no bracket join is needed.  Tracks of
    one point, or shorter than 1e-6, repeat their first point.
    """
    keys = list(keys)
    is_ts = dict(tracks.dtypes)[order].startswith("timestamp")
    sl = time_slice(order) if is_ts else F.floor(F.col(order) / 4096)

    def planar(a: Column, b: Column) -> Column:
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        return F.sqrt(dx * dx + dy * dy)

    d = chain(
        tracks.select(*keys, order, "lon", "lat"), keys, [order], [order, "lon", "lat"], sl, {"len": planar}
    )
    total, first, last = F.col("len_total"), F.col("prev").isNull(), F.col("next").isNull()
    per_unit = F.lit(float(n - 1)) / F.nullif(total, F.lit(0.0))
    done = lambda c: F.least(F.floor(F.col(c) * per_unit), F.lit(n - 2)).cast("int")
    inner = F.when(
        ~first & (done("len") > done("len_before")), F.sequence(done("len_before") + 1, done("len"))
    ).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    targets = F.when(
        total < 1e-6, F.when(first, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(none)
    ).otherwise(
        F.concat(
            F.when(first, F.array(F.lit(0))).otherwise(none),
            inner,
            F.when(last, F.array(F.lit(n - 1))).otherwise(none),
        )
    )
    d = d.withColumn("_step", planar(F.col("prev"), F.struct("lon", "lat"))).withColumn("i", F.explode(targets))
    target = F.when(F.col("i") == n - 1, F.col("len")).otherwise(F.col("i") * total / (n - 1))
    frac = (target - F.col("len_before")) / (F.col("_step") + 1e-6)
    own = first | (total < 1e-6)

    def pos(axis: str) -> Column:
        return F.when(own, F.col(axis)).otherwise(lerp(F.col("prev")[axis], F.col(axis), frac))

    return d.select(*keys, "i", pos("lon").alias("lon"), pos("lat").alias("lat"))


def to_displacement(
    tracks: DataFrame, mode: str = "max", order: str = "i", keys: Sequence[str] = ("track_id",)
) -> DataFrame:
    """Per-axis first differences (leading 0), raw and scaled, with the scale used.

    ``mode='max'`` divides by the largest absolute difference + 1e-6; ``mode='robust'`` by
    the 99th percentile (at least 1e-6) and clips to [-1, 1].
    """
    keys = list(keys)
    linked = chain(
        tracks.select(*keys, order, "lon", "lat"), keys, [order], ["lon", "lat"], F.floor(F.col(order) / 4096)
    )
    d = linked.select(
        *keys,
        order,
        F.coalesce(F.col("lon") - F.col("prev.lon"), F.lit(0.0)).alias("d_lon"),
        F.coalesce(F.col("lat") - F.col("prev.lat"), F.lit(0.0)).alias("d_lat"),
    )
    if mode == "max":
        scale = lambda c: (F.max(F.abs(c)) + 1e-6).alias(f"scale_{c[2:]}")
    elif mode == "robust":
        scale = lambda c: F.greatest(F.percentile(F.abs(c), 0.99), F.lit(1e-6)).alias(f"scale_{c[2:]}")
    else:
        raise ValueError("mode is 'max' or 'robust'")
    out = d.join(d.groupBy(*keys).agg(scale("d_lon"), scale("d_lat")), keys)
    for axis in ("lon", "lat"):
        norm = F.col(f"d_{axis}") / F.col(f"scale_{axis}")
        if mode == "robust":
            norm = F.least(F.greatest(norm, F.lit(-1.0)), F.lit(1.0))
        out = out.withColumn(f"n_{axis}", norm)
    return out


def from_displacement(
    disp: DataFrame, starts: DataFrame, order: str = "i", keys: Sequence[str] = ("track_id",)
) -> DataFrame:
    """Inverse of ``to_displacement``: running sum of ``d_lon``, ``d_lat`` plus the start position."""
    keys = list(keys)
    cum = running_sum(
        disp.select(*keys, order, "d_lon", "d_lat"),
        keys,
        [order],
        {"_x": F.col("d_lon"), "_y": F.col("d_lat")},
        F.floor(F.col(order) / 4096),
    )
    s = starts.select(*keys, F.col("lon").alias("_lon0"), F.col("lat").alias("_lat0"))
    return cum.join(s, keys).select(
        *keys, order, (F.col("_lon0") + F.col("_x")).alias("lon"), (F.col("_lat0") + F.col("_y")).alias("lat")
    )
