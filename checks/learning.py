"""Learning samples, similarity, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import END, I, Q, SEGMENTS_SQL, START, check, hav, points, q, sec, with_points
from checks.fleet import scratch
from checks.tracks import frames_sql
from seawake.operators import forecast, samples, similarity, trips
from seawake.sources.sinks import write_samples

_KMH = f"CASE WHEN t2 > t THEN {hav('lon', 'lat', 'lon2', 'lat2')} / (t2 - t) * 3.6::DOUBLE END"
_QUALITY = f"""qa AS (
  SELECT mmsi, segment_id, count(*) AS n, min(t) AS t1, max(t) AS t2, max({_KMH}) AS kmh FROM sg GROUP BY mmsi, segment_id
), qv AS (SELECT *, n >= 2 AND t2 - t1 >= 14400 AND coalesce(kmh, 0) <= 185 AS valid FROM qa)"""


@check(
    "segment_quality",
    f"""{with_points(SEGMENTS_SQL, _QUALITY)} SELECT mmsi, {I('segment_id')} AS segment_id, {I('n')} AS n_points, {I('t1')} AS t1, {I('t2')} AS t2,
    {Q('kmh', 4)} AS max_kmh, valid FROM qv""",
)
def _(spark, sf):
    s = samples.segment_quality(points(spark, sf))
    return s.select("mmsi", "segment_id", "n_points", sec("start_time").alias("t1"), sec("end_time").alias("t2"), q("max_kmh", 4).alias("max_kmh"), "valid")


@check(
    "valid_segments",
    f"""{with_points(SEGMENTS_SQL, _QUALITY)} SELECT mmsi, {I('segment_id')} AS segment_id, {I('t')} AS t, lon, lat
    FROM sg JOIN (SELECT mmsi, segment_id FROM qv WHERE valid) USING (mmsi, segment_id)""",
)
def _(spark, sf):
    return samples.valid_segments(points(spark, sf)).select("mmsi", "segment_id", sec("ts").alias("t"), "lon", "lat")


@check("spline_resample")
def _(spark, sf):
    s = samples.spline_resample(samples.valid_segments(points(spark, sf)))
    return s.select("mmsi", "segment_id", "k", sec("ts").alias("t"), q("lon").alias("lon"), q("lat").alias("lat"))


@check("samples_from_points")
def _(spark, sf):
    s = samples.samples_from_points(points(spark, sf))
    return s.select("global_traj_id", "mmsi", "segment_id", sec("start_time").alias("t"), F.size("obs").alias("n_obs"), F.size("pred").alias("n_pred"))


# the steps after the spline run on regular frames, which SQL can state on its own
def _grid(spark, sf, step, k="frame"):
    f = trips.resample_frames(points(spark, sf), START, END, step, nth=k == "nth")
    return f.select("mmsi", F.lit(1).cast("long").alias("segment_id"), F.col(k).cast("long").alias("k"), "ts", "lon", "lat")


@check(
    "filter_resampled",
    f"""{with_points(frames_sql(30))}, st AS (SELECT mmsi, frame, tq, lon, lat, lead(tq) OVER w AS t2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2
      FROM fr WINDOW w AS (PARTITION BY mmsi ORDER BY frame)),
    bad AS (SELECT DISTINCT mmsi FROM st WHERE t2 IS NOT NULL AND {hav('lon', 'lat', 'lon2', 'lat2')} / 30 * 3.6::DOUBLE > 40)
    SELECT mmsi, frame AS k, {Q('lon')} AS lon, {Q('lat')} AS lat FROM fr WHERE mmsi NOT IN (SELECT mmsi FROM bad)""",
)
def _(spark, sf):
    g = samples.filter_resampled(_grid(spark, sf, 30), max_kmh=40)
    return g.select("mmsi", "k", q("lon").alias("lon"), q("lat").alias("lat"))


# windows need k = 0, 1, 2, … per segment: frames are renumbered from the first one
def _windows_sql(step: int) -> str:
    return f"""{frames_sql(step)}, fk AS (
  SELECT mmsi, tq, lon::FLOAT::DOUBLE AS lon, lat::FLOAT::DOUBLE AS lat, row_number() OVER (PARTITION BY mmsi ORDER BY frame) - 1 AS k FROM fr
), wn AS (
  SELECT mmsi, w, count(*) AS n, min(tq) AS t1 FROM fk JOIN range(0, 100) g(w) ON k >= w * 120 AND k < w * 120 + 480 GROUP BY mmsi, w HAVING count(*) = 480
), sp AS (
  SELECT wn.mmsi, w, t1, row_number() OVER (ORDER BY wn.mmsi, t1) - 1 AS id FROM wn
)"""


def _windows(spark, sf, step):
    return samples.sliding_samples(_grid(spark, sf, step, "nth"))


@check(
    "sliding_samples",
    f"""{with_points(_windows_sql(30))} SELECT sp.mmsi, {I('t1')} AS t, {I('count(*) FILTER (k - w * 120 < 120)')} AS n_obs,
    {I('count(*) FILTER (k - w * 120 >= 120)')} AS n_pred, {Q('sum(lat) FILTER (k - w * 120 < 120)', 3)} AS sum_obs_lat,
    {Q('sum(lon) FILTER (k - w * 120 >= 120)', 3)} AS sum_pred_lon, {I('max(tq) FILTER (k - w * 120 < 120)')} AS last_obs_t
    FROM sp JOIN fk ON fk.mmsi = sp.mmsi AND k >= w * 120 AND k < w * 120 + 480 GROUP BY sp.mmsi, w, t1""",
)
def _(spark, sf):
    s = _windows(spark, sf, 30)
    total = lambda c, a: F.aggregate(c, F.lit(0.0), lambda t, p: t + p[a].cast("double"))
    return s.select(
        "mmsi", sec("start_time").alias("t"), F.size("obs").cast("long").alias("n_obs"), F.size("pred").cast("long").alias("n_pred"),
        q(total("obs", "lat"), 3).alias("sum_obs_lat"), q(total("pred", "lon"), 3).alias("sum_pred_lon"),
        F.element_at("obs_time", -1).alias("last_obs_t"),
    )


def _stored(spark, sf, step):
    """Numbered samples written and read back: search and forecast start from stored samples."""
    path = scratch(spark) + "/samples"
    write_samples(_windows(spark, sf, step), path)
    return samples.with_global_id(spark.read.parquet(path))


@check("with_global_id", f"{with_points(_windows_sql(30))} SELECT {I('id')} AS global_traj_id, mmsi, {I('t1')} AS t FROM sp")
def _(spark, sf):
    s = samples.with_global_id(_windows(spark, sf, 30))
    return s.select("global_traj_id", "mmsi", sec("start_time").alias("t"))


@check("write_samples", f"{with_points(_windows_sql(60))} SELECT mmsi, {I('t1')} AS t, {I('120')} AS n_obs FROM sp")
def _(spark, sf):
    path = scratch(spark) + "/samples"
    write_samples(_windows(spark, sf, 60), path)
    return spark.read.parquet(path).select("mmsi", sec("start_time").alias("t"), F.size("obs").cast("long").alias("n_obs"))


_BITS = " + ".join(
    f"((x // {1 << b}) % 2) * {1 << (2 * b + 1)} + ((y // {1 << b}) % 2) * {1 << (2 * b)}" for b in range(20)
)


@check(
    "geohash_int",
    f"""{with_points()} SELECT src_id, {I(_BITS)} AS gh FROM (SELECT src_id, CAST(floor((lon + 180) / 360 * 1048576) AS BIGINT) AS x,
    CAST(floor((lat + 90) / 180 * 1048576) AS BIGINT) AS y FROM op)""",
)
def _(spark, sf):
    p = trips.ordered_points(points(spark, sf))
    return p.select("src_id", similarity.geohash_int(F.col("latitude"), F.col("longitude")).alias("gh"))


@check("shape_code")
def _(spark, sf):
    s = similarity.shape_code(_stored(spark, sf, 30))
    return s.select("global_traj_id", "mmsi", "code")


# a 32-bit code per vessel from plain counts, so that SQL can state the search
@check(
    "similar_tracks",
    f"""{with_points()}, cd AS (SELECT mmsi, (count(*) % 256) * 16777216 + (sum(src_id) % 256) * 65536 + (max(src_id) % 16) * 256 + mmsi % 4 AS code
    FROM p GROUP BY mmsi), nn AS (SELECT a.mmsi AS query_id, b.mmsi, xor(CAST(a.code AS BIGINT), CAST(b.code AS BIGINT)) AS x FROM cd a JOIN cd b ON a.mmsi <> b.mmsi)
    SELECT query_id, {I('r')} AS rank, mmsi, {I('x')} AS xor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, mmsi) AS r FROM nn) WHERE r <= 5""",
)
def _(spark, sf):
    code = (F.count("*") % 256) * 16777216 + (F.sum("src_id") % 256) * 65536 + (F.max("src_id") % 16) * 256 + F.first("mmsi") % 4
    c = points(spark, sf).groupBy("mmsi").agg(code.cast("long").alias("code"))
    asked = c.select(F.col("mmsi").alias("query_id"), "code")
    s = similarity.similar_tracks(c, asked, k=5, exclude_self=True, id_col="mmsi")
    return s.select("query_id", F.col("rank").cast("long").alias("rank"), "mmsi", "xor")


@check(
    "forecast_linear",
    f"""{with_points()}, la AS (SELECT mmsi, t, lon, lat, max(t) OVER (PARTITION BY mmsi) AS te FROM op
      QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t DESC) <= 10),
    ft AS (SELECT mmsi, te, regr_slope(lon, t - te) AS a, regr_intercept(lon, t - te) AS b, regr_slope(lat, t - te) AS c, regr_intercept(lat, t - te) AS d
      FROM la GROUP BY mmsi, te HAVING count(*) >= 2)
    SELECT mmsi, {I('i')} AS step, {I('te + i * 300')} AS t, {Q('b + a * i * 300', 5)} AS lon, {Q('d + c * i * 300', 5)} AS lat FROM ft, range(1, 13) g(i)""",
)
def _(spark, sf):
    f = forecast.forecast_linear(points(spark, sf))
    return f.select("mmsi", F.col("step").cast("long").alias("step"), sec("ts").alias("t"), q("lon", 5).alias("lon"), q("lat", 5).alias("lat"))


# retrieval forecast: codes scattered by multiplication, every sample is a query
_MOVES = f"""{_windows_sql(60)}, sc AS (SELECT *, (id * 2654435761) % 4294967296 AS code FROM sp),
pw AS (SELECT id, k - 119 AS step, lon, lat, lon - lag(lon) OVER w AS dx, lat - lag(lat) OVER w AS dy
  FROM sc JOIN fk USING (mmsi) WHERE w = 0 AND k < 480 WINDOW w AS (PARTITION BY id ORDER BY k)),
nb AS (SELECT a.id AS query_id, b.id AS ref FROM sc a JOIN sc b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY xor(CAST(a.code AS BIGINT), CAST(b.code AS BIGINT)), b.id) <= 5),
mv AS (SELECT query_id, step, avg(dx) AS dx, avg(dy) AS dy FROM nb JOIN pw ON pw.id = ref WHERE step >= 1 GROUP BY query_id, step),
pd AS (SELECT query_id, mv.step, o.lon + sum(mv.dx) OVER w AS lon, o.lat + sum(mv.dy) OVER w AS lat
  FROM mv JOIN pw o ON o.id = query_id AND o.step = 0 WINDOW w AS (PARTITION BY query_id ORDER BY mv.step)),
er AS (SELECT query_id, pd.step, sqrt(pow(pd.lon - x.lon, 2) + pow(pd.lat - x.lat, 2)) AS deg, {hav('pd.lon', 'pd.lat', 'x.lon', 'x.lat')} / 1000 AS km,
  x.lon AS tx, x.lat AS ty FROM pd JOIN pw x ON x.id = query_id AND x.step = pd.step),
et AS (SELECT query_id, avg(deg) AS ade, avg(km) AS ade_km, arg_max(deg, step) AS fde, avg(km) FILTER (step <= 120) AS k120,
  {hav('arg_min(tx, step)', 'arg_min(ty, step)', 'arg_max(tx, step)', 'arg_max(ty, step)')} / 1000 AS moved FROM er GROUP BY query_id)"""


def _forecast(spark, sf):
    path = scratch(spark) + "/coded"
    write_samples(_stored(spark, sf, 60).withColumn("code", (F.col("global_traj_id") * 2654435761) % 4294967296), path)
    s = spark.read.parquet(path)
    asked = s.select(F.col("global_traj_id").alias("query_id"), "code", "obs")
    near = similarity.similar_tracks(s, asked, k=5, exclude_self=True)
    truth = s.select(F.col("global_traj_id").alias("query_id"), F.posexplode("pred").alias("i", "p")).select(
        "query_id", (F.col("i") + 1).alias("step"), F.col("p.lon").cast("double").alias("lon"), F.col("p.lat").cast("double").alias("lat")
    )
    return forecast.forecast_retrieval(s, asked, near, k=5), truth


@check(
    "forecast_retrieval",
    f"{with_points(_MOVES)} SELECT {I('query_id')} AS query_id, {I('step')} AS step, {Q('lon', 5)} AS lon, {Q('lat', 5)} AS lat FROM pd",
)
def _(spark, sf):
    f, _ = _forecast(spark, sf)
    return f.select("query_id", F.col("step").cast("long").alias("step"), q("lon", 5).alias("lon"), q("lat", 5).alias("lat"))


@check(
    "forecast_errors",
    f"""{with_points(_MOVES)} SELECT {I('query_id')} AS query_id, {Q('ade', 5)} AS ade_deg, {Q('ade_km', 3)} AS ade_km, {Q('fde', 5)} AS fde_deg,
    {Q('k120', 3)} AS ade_km_120, {Q('moved', 3)} AS true_displacement_km FROM et""",
)
def _(spark, sf):
    e = forecast.forecast_errors(*_forecast(spark, sf))
    return e.select("query_id", q("ade_deg", 5).alias("ade_deg"), q("ade_km", 3).alias("ade_km"), q("fde_deg", 5).alias("fde_deg"), q("ade_km_120", 3).alias("ade_km_120"), q("true_displacement_km", 3).alias("true_displacement_km"))


@check(
    "forecast_metrics",
    f"""{with_points(_MOVES)} SELECT {I('count(*)')} AS n_tracks, {Q('avg(ade)', 5)} AS ade_deg, {Q('avg(ade_km)', 3)} AS ade_km, {Q('avg(fde)', 5)} AS fde_deg,
    {Q('avg(k120)', 3)} AS ade_km_120, {Q('avg(moved)', 3)} AS true_displacement_km FROM et""",
)
def _(spark, sf):
    e = forecast.forecast_metrics(*_forecast(spark, sf))
    return e.select("n_tracks", q("ade_deg", 5).alias("ade_deg"), q("ade_km", 3).alias("ade_km"), q("fde_deg", 5).alias("fde_deg"), q("ade_km_120", 3).alias("ade_km_120"), q("true_displacement_km", 3).alias("true_displacement_km"))
