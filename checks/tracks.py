"""Trajectories, heading, proximity, simplification."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import (
    END, I, PAIRS_SQL, Q, START, T0, T1, TRIPS_SQL, VTRIPS_SQL, bearing, cell, check, hav, pairs, points, q, sec,
    with_points,
)
from checks.fleet import recursive
from seawake.operators import heading, proximity, simplify, trips

# --- T --------------------------------------------------------------------------


@check(
    "build_trips",
    f"""{with_points(TRIPS_SQL)} SELECT mmsi, vessel_name, {I('seq_id')} AS seq_id, {I('t')} AS t, lon, lat,
    {I('t0')} AS prev_t, {I('t2')} AS next_t FROM tr""",
)
def _(spark, sf):
    t = trips.build_trips(points(spark, sf))
    return t.select(
        "mmsi", "vessel_name", "seq_id", sec("ts").alias("t"), "lon", "lat", sec("prev.ts").alias("prev_t"), sec("next.ts").alias("next_t")
    )


@check(
    "legs",
    f"""{with_points(TRIPS_SQL)} SELECT mmsi, vessel_name, {I('seq_id')} AS seq_id, {I('t')} AS t, {I('t2')} AS t2,
    {Q(hav('lon', 'lat', 'lon2', 'lat2'), 3)} AS dist_m, {Q(hav('lon', 'lat', 'lon2', 'lat2') + ' / (t2 - t)')} AS speed_ms
    FROM tr WHERE t2 IS NOT NULL""",
)
def _(spark, sf):
    g = trips.legs(trips.build_trips(points(spark, sf)))
    return g.select(
        "mmsi", "vessel_name", "seq_id", sec("ts").alias("t"), sec("ts2").alias("t2"), q("dist_m", 3).alias("dist_m"),
        q("speed_ms").alias("speed_ms"),
    )


def _at(t: str, axis: str) -> str:
    return f"{axis} + ({axis}2 - {axis}) * (({t} - t) / (t2 - t)::DOUBLE)"


@check(
    "at_period",
    f"""{with_points(TRIPS_SQL)}, ap AS (
      SELECT mmsi, nk, seq_id, t AS tq, lon AS x, lat AS y, FALSE AS interpolated FROM tr WHERE t >= {T0} AND t < {T1}
      UNION ALL SELECT mmsi, nk, seq_id, {T0}, {_at(str(T0), 'lon')}, {_at(str(T0), 'lat')}, TRUE FROM tr WHERE t < {T0} AND t2 > {T0}
      UNION ALL SELECT mmsi, nk, seq_id, {T1}, {_at(str(T1), 'lon')}, {_at(str(T1), 'lat')}, TRUE FROM tr WHERE t < {T1} AND t2 >= {T1})
    SELECT mmsi, nk AS trip_key, {I('seq_id')} AS seq_id, {I('tq')} AS t, {Q('x')} AS lon, {Q('y')} AS lat, interpolated FROM ap""",
)
def _(spark, sf):
    a = trips.at_period(trips.build_trips(points(spark, sf)), START, END)
    return a.select("mmsi", "trip_key", "seq_id", sec("ts").alias("t"), q("lon").alias("lon"), q("lat").alias("lat"), "interpolated")


@check(
    "track_statistics",
    f"""{with_points(TRIPS_SQL)}, c AS (
      SELECT *, least(coalesce(t2, t), {T1}) - greatest(t, {T0}) AS w, {hav('lon', 'lat', 'lon2', 'lat2')} AS m FROM tr
      WHERE t <= {T1} AND coalesce(t2, t) >= {T0})
    , s AS (SELECT mmsi, coalesce(sum(m * w / (t2 - t)), 0) AS m, coalesce(sum(w) FILTER (t2 IS NOT NULL), 0) AS s,
      coalesce(max(m / (t2 - t)) FILTER (w > 0), 0) AS v FROM c GROUP BY mmsi)
    SELECT mmsi, {Q('m / 1000')} AS distance_km, {Q('s / 3600.0::DOUBLE')} AS duration_h,
    {Q('v * 1.94384::DOUBLE')} AS max_speed_kn, {Q('coalesce(m / nullif(s, 0) * 1.94384::DOUBLE, 0)')} AS avg_speed_kn FROM s""",
)
def _(spark, sf):
    s = trips.track_statistics(points(spark, sf), START, END)
    return s.select("mmsi", *[q(c).alias(c) for c in ("distance_km", "duration_h", "max_speed_kn", "avg_speed_kn")])


@check(
    "speed_series",
    f"""{with_points(TRIPS_SQL)} SELECT mmsi, vessel_name, {I('t')} AS t, {Q(
        'CASE WHEN t2 IS NOT NULL THEN ' + hav('lon', 'lat', 'lon2', 'lat2') + ' / (t2 - t) ELSE '
        + hav('lon0', 'lat0', 'lon', 'lat') + ' / (t - t0) END * 1.94384::DOUBLE')} AS speed_kn
    FROM tr WHERE t2 IS NOT NULL OR t0 IS NOT NULL""",
)
def _(spark, sf):
    s = trips.speed_series(points(spark, sf))
    return s.select("mmsi", "vessel_name", sec("ts").alias("t"), q("speed_kn").alias("speed_kn"))


#: position of a vessel at an instant, from the instant or the leg that holds it
def _known(times: str, alias: str = "q") -> str:
    return f"""kn AS (
  SELECT {alias}.*, CASE WHEN v.t = {alias}.tq THEN v.lon ELSE v.lon + (v.lon2 - v.lon) * (({alias}.tq - v.t) / (v.t2 - v.t)::DOUBLE) END AS x,
    CASE WHEN v.t = {alias}.tq THEN v.lat ELSE v.lat + (v.lat2 - v.lat) * (({alias}.tq - v.t) / (v.t2 - v.t)::DOUBLE) END AS y
  FROM {times} {alias} LEFT JOIN vt v ON v.mmsi = {alias}.mmsi AND (v.t = {alias}.tq OR (v.t < {alias}.tq AND v.t2 > {alias}.tq))
)"""


@check(
    "value_at",
    f"""{with_points(VTRIPS_SQL)}, ask AS (SELECT DISTINCT mmsi, {T0} + 1800 * i AS tq FROM p, range(17) r(i)), {_known('ask')}
    SELECT mmsi, {I('tq')} AS t, {Q('x')} AS lon, {Q('y')} AS lat FROM kn""",
)
def _(spark, sf):
    p = points(spark, sf)
    ask = p.select("mmsi").distinct().withColumn(
        "ts", F.explode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.timestamp_seconds(F.lit(T0) + i * 1800)))
    )
    v = trips.value_at(trips.build_trips(p, by_name=False), ask)
    return v.select("mmsi", sec("ts").alias("t"), q("lon").alias("lon"), q("lat").alias("lat"))


@check(
    "trip_summary",
    f"""{with_points(TRIPS_SQL)} SELECT mmsi, nk AS trip_key, {I('min(t)')} AS t1, {I('max(t)')} AS t2, {I('count(*)')} AS n_instants,
    min(lon) AS xmin, max(lon) AS xmax, min(lat) AS ymin, max(lat) AS ymax FROM tr GROUP BY mmsi, nk""",
)
def _(spark, sf):
    s = trips.trip_summary(trips.build_trips(points(spark, sf)))
    return s.select("mmsi", "trip_key", sec("start_time").alias("t1"), sec("end_time").alias("t2"), "n_instants", "mbb.xmin", "mbb.xmax", "mbb.ymin", "mbb.ymax")


@check(
    "time_range",
    f"{with_points()} SELECT mmsi, {I('min(t)')} AS t1, {I('max(t)')} AS t2, {I('count(*)')} AS n_points FROM p GROUP BY mmsi",
)
def _(spark, sf):
    r = trips.time_range(points(spark, sf))
    return r.select("mmsi", sec("start_time").alias("t1"), sec("end_time").alias("t2"), "n_points")


# frames by an as-of join, regardless of gaps
def frames_sql(step: int, start: int = T0, end: int = T1) -> str:
    return f"""nx AS (
  SELECT mmsi, t, lon, lat, sog, cog, lead(t) OVER w AS t2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2
  FROM op WINDOW w AS (PARTITION BY mmsi ORDER BY t)
), gr AS (
  SELECT mmsi, CAST(i AS BIGINT) AS frame, {start} + {step} * CAST(i AS BIGINT) AS tq
  FROM (SELECT DISTINCT mmsi FROM op), range({(end - start) // step + 1}) r(i)
), fr AS (
  SELECT g.mmsi, g.frame, g.tq, n.sog, n.cog,
    CASE WHEN n.t = g.tq OR n.t2 IS NULL THEN n.lon ELSE n.lon + (n.lon2 - n.lon) * ((g.tq - n.t) / (n.t2 - n.t)::DOUBLE) END AS lon,
    CASE WHEN n.t = g.tq OR n.t2 IS NULL THEN n.lat ELSE n.lat + (n.lat2 - n.lat) * ((g.tq - n.t) / (n.t2 - n.t)::DOUBLE) END AS lat
  FROM gr g ASOF JOIN nx n ON n.mmsi = g.mmsi AND n.t <= g.tq
)"""


@check(
    "resample_frames",
    f"""{with_points(frames_sql(300))} SELECT mmsi, frame, {I('tq')} AS t, {Q('lon')} AS lon, {Q('lat')} AS lat,
    coalesce(sog, 0) AS sog, coalesce(cog, 0) AS cog FROM fr""",
)
def _(spark, sf):
    f = trips.resample_frames(points(spark, sf), START, END, 300)
    return f.select("mmsi", F.col("frame").cast("long").alias("frame"), sec("ts").alias("t"), q("lon").alias("lon"), q("lat").alias("lat"), "sog", "cog")


@check(
    "frame_trails",
    f"""{with_points(frames_sql(300))} SELECT mmsi, frame, {I('count(*) OVER w')} AS n_trail, {I('min(tq) OVER w')} AS first_t,
    {Q('sum(lon) OVER w', 5)} AS sum_lon FROM fr WINDOW w AS (PARTITION BY mmsi ORDER BY frame ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    f = trips.frame_trails(trips.resample_frames(points(spark, sf), START, END, 300))
    total = F.aggregate("trail", F.lit(0.0), lambda a, r: a + r["lon"])
    return f.select(
        "mmsi", F.col("frame").cast("long").alias("frame"), F.size("trail").cast("long").alias("n_trail"),
        sec(F.col("trail")[0]["ts"]).alias("first_t"), q(total, 5).alias("sum_lon"),
    )


_ARC = """ar_l AS (
  SELECT mmsi, t, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, row_number() OVER w AS j
  FROM op WINDOW w AS (PARTITION BY mmsi ORDER BY t)
), ar_c AS (
  SELECT *, coalesce(sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)), 0) AS d,
    sum(coalesce(sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)), 0)) OVER (PARTITION BY mmsi ORDER BY t) AS e FROM ar_l
), ar_t AS (
  SELECT mmsi, max(e) AS total, arg_min(lon, t) AS x0, arg_min(lat, t) AS y0 FROM ar_c GROUP BY mmsi
), arc AS (
  SELECT t.mmsi, CAST(i AS BIGINT) AS i, x0 AS lon, y0 AS lat FROM ar_t t, range(50) r(i) WHERE total < 1e-6
  UNION ALL
  SELECT mmsi, 0, x0, y0 FROM ar_t WHERE total >= 1e-6
  UNION ALL
  SELECT mmsi, 49, lon0 + (lon - lon0) * d / (d + 1e-6), lat0 + (lat - lat0) * d / (d + 1e-6) FROM (
    SELECT *, sqrt(pow(lon - lon0, 2) + pow(lat - lat0, 2)) AS d FROM (
      SELECT mmsi, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lead(t) OVER w AS t2
      FROM op WINDOW w AS (PARTITION BY mmsi ORDER BY t)) JOIN ar_t USING (mmsi) WHERE t2 IS NULL AND total >= 1e-6)
  UNION ALL
  SELECT g.mmsi, g.i, c.lon + (c.lon2 - c.lon) * (g.target - (c.e - c.d)) / (c.d + 1e-6),
    c.lat + (c.lat2 - c.lat) * (g.target - (c.e - c.d)) / (c.d + 1e-6)
  FROM (SELECT mmsi, CAST(i AS BIGINT) AS i, i * total / 49 AS target
        FROM ar_t, range(1, 49) r(i) WHERE total >= 1e-6) g
  JOIN ar_c c ON c.mmsi = g.mmsi AND c.d > 0 AND g.target <= c.e AND g.target > c.e - c.d
)"""


def _arc(spark, sf, n=50):
    p = trips.ordered_points(points(spark, sf)).select(
        F.col("mmsi").alias("track_id"), F.col("base_date_time").alias("ts"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat")
    )
    return trips.resample_arclength(p, n)


@check("resample_arclength", f"{with_points(_ARC)} SELECT mmsi, i, {Q('lon', 5)} AS lon, {Q('lat', 5)} AS lat FROM arc")
def _(spark, sf):
    a = _arc(spark, sf)
    return a.select(F.col("track_id").alias("mmsi"), F.col("i").cast("long").alias("i"), q("lon", 5).alias("lon"), q("lat", 5).alias("lat"))


_FRAME_TRACK = frames_sql(600)
_DISP = f"""{_FRAME_TRACK}, dp AS (
  SELECT mmsi, frame, lon, lat, coalesce(lon - lag(lon) OVER w, 0) AS dx, coalesce(lat - lag(lat) OVER w, 0) AS dy
  FROM fr WINDOW w AS (PARTITION BY mmsi ORDER BY frame)
)"""


def _frame_tracks(spark, sf):
    f = trips.resample_frames(points(spark, sf), START, END, 600)
    return f.select(F.col("mmsi").alias("track_id"), F.col("frame").alias("i"), "lon", "lat")


@check(
    "to_displacement",
    f"""{with_points(_DISP)}, sc AS (SELECT mmsi, max(abs(dx)) + 1e-6 AS sx, max(abs(dy)) + 1e-6 AS sy FROM dp GROUP BY mmsi)
    SELECT d.mmsi, d.frame, {Q('dx', 8)} AS d_lon, {Q('dy', 8)} AS d_lat, {Q('dx / sx')} AS n_lon, {Q('dy / sy')} AS n_lat
    FROM dp d JOIN sc USING (mmsi)""",
)
def _(spark, sf):
    d = trips.to_displacement(_frame_tracks(spark, sf))
    return d.select(F.col("track_id").alias("mmsi"), F.col("i").cast("long").alias("frame"), q("d_lon", 8).alias("d_lon"), q("d_lat", 8).alias("d_lat"), q("n_lon").alias("n_lon"), q("n_lat").alias("n_lat"))


@check(
    "to_displacement_robust",
    f"""{with_points(_DISP)}, sc AS (SELECT mmsi, greatest(quantile_cont(abs(dx), 0.99), 1e-6) AS sx,
    greatest(quantile_cont(abs(dy), 0.99), 1e-6) AS sy FROM dp GROUP BY mmsi)
    SELECT d.mmsi, d.frame, {Q('greatest(least(dx / sx, 1.0), -1.0)')} AS n_lon,
    {Q('greatest(least(dy / sy, 1.0), -1.0)')} AS n_lat FROM dp d JOIN sc USING (mmsi)""",
)
def _(spark, sf):
    d = trips.to_displacement(_frame_tracks(spark, sf), mode="robust")
    return d.select(F.col("track_id").alias("mmsi"), F.col("i").cast("long").alias("frame"), q("n_lon").alias("n_lon"), q("n_lat").alias("n_lat"))


@check("from_displacement", f"{with_points(_FRAME_TRACK)} SELECT mmsi, frame, {Q('lon')} AS lon, {Q('lat')} AS lat FROM fr")
def _(spark, sf):
    t = _frame_tracks(spark, sf)
    start = t.groupBy("track_id").agg(F.min(F.struct("i", "lon", "lat")).alias("s")).select("track_id", "s.lon", "s.lat")
    b = trips.from_displacement(trips.to_displacement(t), start)
    return b.select(F.col("track_id").alias("mmsi"), F.col("i").cast("long").alias("frame"), q("lon").alias("lon"), q("lat").alias("lat"))


# --- simplification: the split tree by recursion over stretches ------------------


def _split(floor_m: float) -> str:
    chord = "(yb - ya) * o.lon - (xb - xa) * o.lat + xb * ya - yb * xa"
    dist = (
        "CASE WHEN xa = xb AND ya = yb THEN sqrt(pow(o.lon - xa, 2) + pow(o.lat - ya, 2)) "
        f"ELSE abs({chord}) / sqrt(pow(xb - xa, 2) + pow(yb - ya, 2)) END"
    )
    return f"""st AS (
  SELECT mmsi, min(t) AS a, max(t) AS b, arg_min(lon, t) AS xa, arg_min(lat, t) AS ya, arg_max(lon, t) AS xb, arg_max(lat, t) AS yb,
    CAST('inf' AS DOUBLE) AS cap, CAST(NULL AS BIGINT) AS m, CAST(NULL AS DOUBLE) AS level FROM op GROUP BY mmsi
  UNION ALL
  (WITH far AS (
    SELECT s.mmsi, s.a, s.b, s.xa, s.ya, s.xb, s.yb, s.cap, o.t, o.lon, o.lat, {dist} AS d
    FROM st s JOIN op o ON o.mmsi = s.mmsi AND o.t > s.a AND o.t < s.b
    QUALIFY row_number() OVER (PARTITION BY s.mmsi, s.a, s.b ORDER BY {dist} DESC, o.t) = 1
  ), hit AS (SELECT *, least(cap, d) AS lv FROM far WHERE d > {floor_m!r}::DOUBLE / 111000)
  SELECT mmsi, a, t, xa, ya, lon, lat, lv, t, lv FROM hit
  UNION ALL SELECT mmsi, t, b, lon, lat, xb, yb, lv, NULL, NULL FROM hit)
), lev AS (
  SELECT mmsi, m AS t, level FROM st WHERE m IS NOT NULL
  UNION SELECT mmsi, min(t), CAST('inf' AS DOUBLE) FROM op GROUP BY mmsi
  UNION SELECT mmsi, max(t), CAST('inf' AS DOUBLE) FROM op GROUP BY mmsi
)"""


@check("simplify", recursive(f"{with_points(_split(100))} SELECT mmsi, {I('t')} AS t FROM lev"))
def _(spark, sf):
    return simplify.simplify(points(spark, sf)).select("mmsi", sec("ts").alias("t"))


_COMPARE = f"""{with_points(_split(50))}, cmp AS (SELECT mmsi, tolerance_m, count(*) AS k FROM lev,
  (VALUES (50.0::DOUBLE), (100.0::DOUBLE), (200.0::DOUBLE), (500.0::DOUBLE)) v(tolerance_m)
  WHERE level > tolerance_m / 111000 GROUP BY mmsi, tolerance_m),
  sz AS (SELECT mmsi, count(*) AS n, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM op GROUP BY mmsi)"""


@check(
    "simplify_comparison",
    recursive(
        f"""{_COMPARE} SELECT mmsi, tolerance_m, {I('k')} AS kept_points, {I('n')} AS original_points,
        {Q('(1 - k / n::DOUBLE) * 100', 2)} AS compression_pct FROM cmp JOIN sz USING (mmsi)"""
    ),
)
def _(spark, sf):
    c = simplify.simplify_comparison(points(spark, sf))
    return c.select("mmsi", "tolerance_m", "kept_points", "original_points", q("compression_pct", 2).alias("compression_pct"))


@check(
    "simplify_stats",
    recursive(
        f"""{_COMPARE} SELECT mmsi, {I('k')} AS kept_points, {I('n')} AS original_points, min_lon, max_lon, min_lat, max_lat,
        {Q('(1 - k / n::DOUBLE) * 100', 2)} AS compression_pct FROM cmp JOIN sz USING (mmsi) WHERE tolerance_m = 100"""
    ),
)
def _(spark, sf):
    c = simplify.simplify_stats(points(spark, sf))
    return c.select("mmsi", "kept_points", "original_points", "min_lon", "max_lon", "min_lat", "max_lat", q("compression_pct", 2).alias("compression_pct"))


# --- H --------------------------------------------------------------------------

_HEADINGS = f"""hd_l AS (SELECT mmsi, t, lon, lat, {bearing('lon', 'lat', 'lon2', 'lat2')} AS h FROM vt),
hd_n AS (SELECT mmsi FROM hd_l WHERE h IS NOT NULL GROUP BY mmsi HAVING count(*) >= 2),
hd_u AS (SELECT * FROM hd_l WHERE h IS NOT NULL AND mmsi IN (SELECT mmsi FROM hd_n)
  UNION ALL SELECT mmsi, t, lon, lat, cog FROM op WHERE cog IS NOT NULL AND mmsi NOT IN (SELECT mmsi FROM hd_n)),
hd AS (SELECT *, CASE WHEN h - h0 > 180 THEN h - h0 - 360 WHEN h - h0 < -180 THEN h - h0 + 360 ELSE h - h0 END AS turn,
  (t - t0) / 60.0::DOUBLE AS dt FROM (SELECT *, lag(h) OVER w AS h0, lag(t) OVER w AS t0 FROM hd_u WINDOW w AS (PARTITION BY mmsi ORDER BY t)))"""


@check(
    "heading_series",
    f"{with_points(VTRIPS_SQL, _HEADINGS)} SELECT mmsi, {I('t')} AS t, {Q('h', 5)} AS heading, {Q('turn', 5)} AS turn_deg, {Q('turn / dt', 5)} AS turn_rate FROM hd",
)
def _(spark, sf):
    h = heading.heading_series(points(spark, sf))
    return h.select("mmsi", sec("ts").alias("t"), q("heading", 5).alias("heading"), q("turn_deg", 5).alias("turn_deg"), q("turn_rate", 5).alias("turn_rate"))


@check(
    "heading_analysis",
    f"""{with_points(VTRIPS_SQL, _HEADINGS)} SELECT mmsi, {I('count(*)')} AS n_points, {Q('min(h)', 5)} AS min_heading,
    {Q('max(h)', 5)} AS max_heading, {Q('avg(h)', 5)} AS avg_heading, {Q('coalesce(stddev_samp(h), 0)', 4)} AS heading_std,
    {Q('coalesce(sum(abs(turn)), 0)', 4)} AS total_turn_deg,
    {Q('(degrees(atan2(avg(sin(radians(h))), avg(cos(radians(h))))) + 360) % 360', 4)} AS circular_mean FROM hd GROUP BY mmsi""",
)
def _(spark, sf):
    h = heading.heading_analysis(points(spark, sf))
    return h.select(
        "mmsi", "n_points", *[q(c, 5).alias(c) for c in ("min_heading", "max_heading", "avg_heading")],
        *[q(c, 4).alias(c) for c in ("heading_std", "total_turn_deg", "circular_mean")],
    )


@check(
    "turn_events",
    f"""{with_points(VTRIPS_SQL, _HEADINGS)} SELECT mmsi, {I('t')} AS t, {Q('h0', 5)} AS heading_before, {Q('h', 5)} AS heading_after,
    {Q('turn', 5)} AS turn_deg, {Q('turn / dt', 5)} AS turn_rate, lon, lat FROM hd WHERE abs(turn / dt) > 5""",
)
def _(spark, sf):
    e = heading.turn_events(points(spark, sf))
    return e.select("mmsi", sec("ts").alias("t"), *[q(c, 5).alias(c) for c in ("heading_before", "heading_after", "turn_deg", "turn_rate")], "lon", "lat")


@check(
    "heading_grid",
    f"""{with_points(VTRIPS_SQL, _HEADINGS)} SELECT {cell('lon', 0.05)} AS cell_x, {cell('lat', 0.05)} AS cell_y, {Q('avg(h)', 5)} AS avg_heading,
    {I('count(*)')} AS n_points, {Q('stddev_samp(h)', 4)} AS heading_std FROM hd_l WHERE h IS NOT NULL
    GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY n_points DESC, cell_x, cell_y LIMIT 1000""",
)
def _(spark, sf):
    g = heading.heading_grid(points(spark, sf))
    return g.select("cell_x", "cell_y", q("avg_heading", 5).alias("avg_heading"), "n_points", q("heading_std", 4).alias("heading_std"))


# --- P --------------------------------------------------------------------------

_NOON = dt.datetime(2025, 1, 1, 6, tzinfo=dt.timezone.utc)
_T_NOON = int(_NOON.timestamp())


@check(
    "distance_at",
    f"""{with_points(VTRIPS_SQL, PAIRS_SQL)}, ask AS (SELECT DISTINCT mmsi, {_T_NOON} AS tq FROM p), {_known('ask')}
    SELECT mmsi_a, mmsi_b, {Q('a.x')} AS lon_a, {Q('a.y')} AS lat_a, {Q('b.x')} AS lon_b, {Q('b.y')} AS lat_b,
    {Q(hav('a.x', 'a.y', 'b.x', 'b.y'), 3)} AS distance_m FROM pr JOIN kn a ON a.mmsi = mmsi_a JOIN kn b ON b.mmsi = mmsi_b""",
)
def _(spark, sf):
    d = proximity.distance_at(points(spark, sf), pairs(spark, sf), _NOON)
    return d.select("mmsi_a", "mmsi_b", *[q(c).alias(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b")], q("distance_m", 3).alias("distance_m"))


def _on(v: str, t: str, axis: str) -> str:
    return f"({v}.{axis} + ({v}.{axis}2 - {v}.{axis}) * (({t} - {v}.t) / ({v}.t2 - {v}.t)::DOUBLE))"


_APPROACH = f"""lp AS (
  SELECT mmsi_a, mmsi_b, greatest(a.t, b.t) AS s, least(a.t2, b.t2) AS e,
    a.lon AS alon, a.lon2 AS alon2, a.lat AS alat, a.lat2 AS alat2, a.t AS tq, a.t2 AS at2,
    b.lon AS blon, b.lon2 AS blon2, b.lat AS blat, b.lat2 AS blat2, b.t AS bt, b.t2 AS bt2
  FROM pr JOIN vt a ON a.mmsi = mmsi_a AND a.t2 IS NOT NULL
  JOIN vt b ON b.mmsi = mmsi_b AND b.t2 IS NOT NULL AND b.t <= a.t2 AND b.t2 >= a.t
), rel AS (
  SELECT *, (ex - sx) AS dx, (ey - sy) AS dy FROM (
    SELECT *, (pos(blon, blon2, bt, bt2, s) - pos(alon, alon2, tq, at2, s)) * kx AS sx,
      pos(blat, blat2, bt, bt2, s) - pos(alat, alat2, tq, at2, s) AS sy,
      (pos(blon, blon2, bt, bt2, e) - pos(alon, alon2, tq, at2, e)) * kx AS ex,
      pos(blat, blat2, bt, bt2, e) - pos(alat, alat2, tq, at2, e) AS ey
    FROM (SELECT *, cos(radians((pos(alat, alat2, tq, at2, s) + pos(blat, blat2, bt, bt2, s)) / 2)) AS kx FROM lp))
), best AS (
  SELECT *, s + coalesce(greatest(least(-(sx * dx + sy * dy) / nullif(dx * dx + dy * dy, 0), 1.0), 0.0), 0.0) * (e - s) AS tt FROM rel
)"""


def _expand_pos(sql: str) -> str:
    import re

    return re.sub(r"pos\((\w+), (\w+), (\w+), (\w+), (\w+)\)", r"(\1 + (\2 - \1) * ((\5 - \3) / (\4 - \3)::DOUBLE))", sql)


_AT_T = hav("pos(alon, alon2, tq, at2, tt)", "pos(alat, alat2, tq, at2, tt)", "pos(blon, blon2, bt, bt2, tt)", "pos(blat, blat2, bt, bt2, tt)")


@check(
    "nearest_approach",
    _expand_pos(
        f"""{with_points(VTRIPS_SQL, PAIRS_SQL, _APPROACH)} SELECT mmsi_a, mmsi_b, {Q(f'min({_AT_T})', 2)} AS distance_m
        FROM best GROUP BY mmsi_a, mmsi_b"""
    ),
)
def _(spark, sf):
    n = proximity.nearest_approach(points(spark, sf), pairs(spark, sf))
    return n.select("mmsi_a", "mmsi_b", q("distance_m", 2).alias("distance_m"))


def _aligned(join: str) -> str:
    return f"""al AS (
  SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.t AS ta, b.t AS tb, a.src_id AS sa, b.src_id AS sb, a.vessel_name AS na,
    b.vessel_name AS nb, coalesce(a.sog, 0) AS ga, coalesce(b.sog, 0) AS gb, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d
  FROM {join}
)"""


_PAIRED = _aligned(
    """pr JOIN p a ON a.mmsi = pr.mmsi_a AND a.lon IS NOT NULL JOIN p b ON b.mmsi = pr.mmsi_b AND b.lon IS NOT NULL AND abs(a.t - b.t) <= 60"""
)
_FLEET = _aligned("p a JOIN p b ON a.mmsi < b.mmsi AND a.lon IS NOT NULL AND b.lon IS NOT NULL AND abs(a.t - b.t) <= 60")
_CPA = f"""SELECT mmsi_a, mmsi_b, {I('ta')} AS cpa_t, {I('abs(ta - tb)')} AS time_diff_s, {Q('d', 3)} AS min_distance_m,
  CASE WHEN d / 1852 < 0.5 THEN 'danger' WHEN d / 1852 < 1 THEN 'warning' ELSE 'safe' END AS safety_status,
  na AS name_a, nb AS name_b, ga AS sog_a, gb AS sog_b FROM al"""
_CPA_END = "QUALIFY row_number() OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY d, ta, tb, sa, sb) = 1"


def _cpa_columns(c):
    return c.select(
        "mmsi_a", "mmsi_b", sec("cpa_time").alias("cpa_t"), F.col("time_diff_s").cast("long").alias("time_diff_s"),
        q("min_distance_m", 3).alias("min_distance_m"), "safety_status", "name_a", "name_b", "sog_a", "sog_b",
    )


@check("cpa", f"{with_points(_FLEET)} {_CPA} WHERE d < 1852 {_CPA_END}")
def _(spark, sf):
    return _cpa_columns(proximity.cpa(points(spark, sf)))


@check("cpa_of_pairs", f"{with_points(PAIRS_SQL, _PAIRED)} {_CPA} {_CPA_END}")
def _(spark, sf):
    return _cpa_columns(proximity.cpa(points(spark, sf), pairs(spark, sf)))


@check(
    "distance_series",
    f"""{with_points(PAIRS_SQL, _PAIRED)} SELECT mmsi_a, mmsi_b, {I('ta')} AS t_a, {I('tb')} AS t_b, sa AS src_id_a, sb AS src_id_b,
    {Q('d', 3)} AS distance_m FROM al""",
)
def _(spark, sf):
    d = proximity.distance_series(points(spark, sf), pairs(spark, sf))
    return d.select("mmsi_a", "mmsi_b", sec("time_a").alias("t_a"), sec("time_b").alias("t_b"), "src_id_a", "src_id_b", q("distance_m", 3).alias("distance_m"))


_NM = hav("a.lon", "a.lat", "b.lon", "b.lat", 3440.065)
_COMPANIONS = f"""vr AS (
  SELECT mmsi, count(*) AS n FROM op GROUP BY mmsi
  HAVING min(t) <= {T1} AND max(t) >= {T0} AND count(*) FILTER (t BETWEEN {T0} AND {T1}) >= 3
), vp AS (
  SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b FROM vr a JOIN vr b ON a.n > b.n OR (a.n = b.n AND a.mmsi < b.mmsi)
), wp AS (SELECT * FROM op WHERE t BETWEEN {T0} AND {T1}
), nr AS (
  SELECT mmsi_a, mmsi_b, a.t, {_NM} AS nm FROM vp JOIN wp a ON a.mmsi = mmsi_a
  JOIN wp b ON b.mmsi = mmsi_b AND abs(a.t - b.t) < 300
  QUALIFY row_number() OVER (PARTITION BY mmsi_a, mmsi_b, a.t ORDER BY abs(a.t - b.t), b.t) = 1
), sg_c AS (
  SELECT *, sum(CASE WHEN nm > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY t) AS seg FROM nr
), cs AS (
  SELECT mmsi_a, mmsi_b, seg, min(t) AS t1, max(t) AS t2, count(*) AS n, avg(nm) AS nm_avg, min(nm) AS nm_min, max(nm) AS nm_max
  FROM sg_c WHERE nm <= 2 GROUP BY mmsi_a, mmsi_b, seg HAVING count(*) >= 2 AND max(t) - min(t) >= 1800
), cp AS (
  SELECT mmsi_a, mmsi_b, sum(t2 - t1) / 60.0::DOUBLE AS minutes, sum(n) AS n, count(*) AS k, min(nm_min) AS nm_min, max(nm_max) AS nm_max
  FROM cs GROUP BY mmsi_a, mmsi_b
)"""


@check(
    "companion_segments",
    f"""{with_points(_COMPANIONS)} SELECT mmsi_a, mmsi_b, {I('t1')} AS t1, {I('t2')} AS t2, {I('n')} AS n_points,
    {Q('nm_avg')} AS avg_nm, {Q('nm_min')} AS min_nm, {Q('nm_max')} AS max_nm FROM cs""",
)
def _(spark, sf):
    c = proximity.companion_segments(points(spark, sf), START, END)
    return c.select(
        "mmsi_a", "mmsi_b", sec("start_time").alias("t1"), sec("end_time").alias("t2"), "n_points",
        q("avg_distance_nm").alias("avg_nm"), q("min_distance_nm").alias("min_nm"), q("max_distance_nm").alias("max_nm"),
    )


_PAIR_COLS = f"{Q('minutes')} AS total_duration_min, {I('n')} AS total_points, {I('k')} AS n_segments, {Q('least(100.0, minutes / 10)')} AS score"


def _pair_columns(c, *extra):
    return c.select("mmsi_a", "mmsi_b", q("total_duration_min").alias("total_duration_min"), "total_points", "n_segments", q("score").alias("score"), *extra)


@check("companion_pairs", f"{with_points(_COMPANIONS)} SELECT mmsi_a, mmsi_b, {_PAIR_COLS} FROM cp")
def _(spark, sf):
    return _pair_columns(proximity.companion_pairs(points(spark, sf), START, END))


@check(
    "companions_of",
    f"""{with_points(_COMPANIONS)} SELECT mmsi_a, mmsi_b, {_PAIR_COLS}, CASE WHEN mmsi_a = 200000003 THEN mmsi_b ELSE mmsi_a END AS companion
    FROM cp WHERE 200000003 IN (mmsi_a, mmsi_b)""",
)
def _(spark, sf):
    pairs_ = proximity.companion_pairs(points(spark, sf), START, END, mmsi=200000003)
    return _pair_columns(proximity.companions_of(pairs_, 200000003), "companion")


@check(
    "companion_groups",
    recursive(
        f"""{with_points(_COMPANIONS)}, ed AS (SELECT mmsi_a AS u, mmsi_b AS v FROM cp UNION SELECT mmsi_b, mmsi_a FROM cp),
        rc(u, v) AS (SELECT u, v FROM ed UNION SELECT rc.u, ed.v FROM rc JOIN ed ON ed.u = rc.v),
        cc AS (SELECT u AS mmsi, least(u, min(v)) AS g FROM rc GROUP BY u)
        SELECT g AS group_id, mmsi, {I('count(*) OVER (PARTITION BY g)')} AS size,
          (SELECT {I('count(*)')} FROM cp JOIN cc c2 ON c2.mmsi = cp.mmsi_a WHERE c2.g = cc.g) AS n_pairs
        FROM cc QUALIFY count(*) OVER (PARTITION BY g) >= 3"""
    ),
)
def _(spark, sf):
    return proximity.companion_groups(proximity.companion_pairs(points(spark, sf), START, END))


_BEARINGS = f"""{PAIRS_SQL}, ask AS (
  SELECT mmsi_a, mmsi_b, t AS tq FROM pr JOIN vt ON vt.mmsi = mmsi_a WHERE t BETWEEN {T0} AND {T1}
  UNION SELECT mmsi_a, mmsi_b, t FROM pr JOIN vt ON vt.mmsi = mmsi_b WHERE t BETWEEN {T0} AND {T1}
), asked AS (SELECT mmsi_a, mmsi_b, tq, mmsi_a AS mmsi, 'a' AS side FROM ask UNION ALL SELECT mmsi_a, mmsi_b, tq, mmsi_b, 'b' FROM ask
), {_known('asked')}, rb AS (
  SELECT a.mmsi_a, a.mmsi_b, a.tq, {bearing('a.x', 'a.y', 'b.x', 'b.y')} AS br FROM kn a JOIN kn b USING (mmsi_a, mmsi_b, tq)
  WHERE a.side = 'a' AND b.side = 'b' AND a.x IS NOT NULL AND b.x IS NOT NULL
)"""


@check(
    "relative_bearing",
    f"{with_points(VTRIPS_SQL, _BEARINGS)} SELECT mmsi_a, mmsi_b, {I('tq')} AS t, {Q('br', 4)} AS bearing FROM rb WHERE br IS NOT NULL",
)
def _(spark, sf):
    b = proximity.relative_bearing(points(spark, sf), pairs(spark, sf), START, END)
    return b.select("mmsi_a", "mmsi_b", sec("ts").alias("t"), q("bearing", 4).alias("bearing"))


@check(
    "relative_bearing_summary",
    f"""{with_points(VTRIPS_SQL, _BEARINGS)} SELECT mmsi_a, mmsi_b, {I('count(*)')} AS n, {Q('avg(br)', 4)} AS avg_bearing,
    {Q('min(br)', 4)} AS min_bearing, {Q('max(br)', 4)} AS max_bearing FROM rb WHERE br IS NOT NULL GROUP BY mmsi_a, mmsi_b""",
)
def _(spark, sf):
    s = proximity.relative_bearing_summary(proximity.relative_bearing(points(spark, sf), pairs(spark, sf), START, END))
    return s.select("mmsi_a", "mmsi_b", "n", *[q(c, 4).alias(c) for c in ("avg_bearing", "min_bearing", "max_bearing")])
