"""Sources, sinks, registry, density and events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks.base import (
    END, I, Q, SEGMENTS_SQL, START, T0, T1, TRIPS_SQL, VIEWPORT, cell, check, hav, points, q, sec,
    with_points, zones, zones_sql,
)
from seawake.operators import density, events, registry, trips
from seawake.sources import positions, sinks
from seawake.sources import zones as zone_source


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared folder of the cluster, or a local one where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="seawake-")


# --- SRC ------------------------------------------------------------------------

_TYPED = ["mmsi", "t", "longitude", "latitude", "sog", "vessel_name", "vessel_type", "length", "imo"]


def _as_text(p):
    """Points as messy text under foreign headers, with one unparsable number in 1000."""
    ts = F.date_format("base_date_time", "yyyy-MM-dd HH:mm:ss")
    return p.select(
        F.concat(F.lit(" "), F.col("mmsi").cast("string")).alias("MMSI"),
        ts.alias("BaseDateTime"),
        F.when(F.col("src_id") % 1000 == 7, F.lit("n/a")).otherwise(F.col("latitude").cast("string")).alias("LAT"),
        F.col("longitude").cast("string").alias("LON"),
        F.col("sog").cast("string").alias("SOG"),
        F.concat(F.col("vessel_name"), F.lit(" ")).alias("Vessel Name"),
        F.col("vessel_type").cast("string").alias("vessel-type"),
        F.lit("").alias("Length"),
    )


_TEXT_SQL = f"""SELECT mmsi, {I('t')} AS t, lon AS longitude,
  CASE WHEN src_id % 1000 <> 7 THEN lat END AS latitude, sog, vessel_name, {I('vessel_type')} AS vessel_type,
  CAST(NULL AS DOUBLE) AS length, CAST(NULL AS VARCHAR) AS imo FROM p"""


def _typed(df):
    return df.withColumn("t", sec("base_date_time")).withColumn("vessel_type", F.col("vessel_type").cast("long")).select(*_TYPED)


@check("read_positions_csv", f"{with_points()} {_TEXT_SQL}")
def _(spark, sf):
    folder = scratch(spark) + "/csv"
    _as_text(points(spark, sf)).write.option("header", True).csv(folder)
    return _typed(positions.read_positions_csv(spark, folder, glob="*.csv"))


@check("read_positions_folder", f"{with_points()} {_TEXT_SQL}")
def _(spark, sf):
    """One folder with files of two column orders, and one that has no position."""
    folder, p = scratch(spark) + "/csv", _as_text(points(spark, sf))
    even = F.col("MMSI").cast("long") % 2 == 0
    save = lambda df: df.write.mode("append").option("header", True).csv(folder)
    save(p.where(even))
    save(p.where(~even).select(*reversed(p.columns)))
    save(p.drop("LAT").limit(5))
    return _typed(positions.read_positions_csv(spark, folder, glob="*.csv"))


@check(
    "read_positions_encodings",
    f"""{with_points()} SELECT mmsi, {I('t')} AS t, lon AS longitude, CASE WHEN src_id % 1000 <> 7 THEN lat END AS latitude,
    CASE WHEN vessel_name IS NOT NULL AND (mmsi % 2 = 0 OR t >= {T1}) THEN '长江 ' || vessel_name ELSE vessel_name END AS vessel_name FROM p""",
)
def _(spark, sf):
    """GBK files whose names leave ASCII only in their last rows, beside UTF-8 files that do so from the start."""
    folder, p = scratch(spark) + "/csv", _as_text(points(spark, sf))
    even = F.col("MMSI").cast("long") % 2 == 0
    late = F.to_timestamp(F.trim("BaseDateTime")) >= F.lit(END)
    name = F.col("`Vessel Name`")
    p = p.withColumn("Vessel Name", F.when(even | late, F.concat(F.lit("长江 "), F.trim(name))).otherwise(name))
    p.where(even).write.option("header", True).csv(folder)
    legacy = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark writes its standard charsets only unless told otherwise
    try:
        # by time, so that all but the last file of the range have ASCII names throughout
        odd = p.where(~even).repartitionByRange(4, "BaseDateTime").sortWithinPartitions("BaseDateTime")
        odd.write.mode("append").option("header", True).option("encoding", "GBK").csv(folder)
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", legacy)
    got = positions.read_positions_csv(spark, folder, glob="*.csv")
    return got.select("mmsi", sec("base_date_time").alias("t"), "longitude", "latitude", "vessel_name")


@check("type_positions", f"{with_points()} {_TEXT_SQL}")
def _(spark, sf):
    return _typed(positions.type_positions(_as_text(points(spark, sf))))


@check("rejected_rows", f"{with_points()} SELECT mmsi, {I('t')} AS t FROM p WHERE src_id % 1000 = 7")
def _(spark, sf):
    bad = positions.rejected_rows(_as_text(points(spark, sf)))
    return bad.select(F.trim("MMSI").cast("long").alias("mmsi"), sec(F.to_timestamp("BaseDateTime")).alias("t"))


@check(
    "clean_points",
    f"{with_points()} SELECT mmsi, {I('t')} AS t, lon AS longitude, lat AS latitude, sog FROM p "
    "WHERE lon IS NOT NULL AND lat IS NOT NULL AND src_id % 1000 <> 7",
)
def _(spark, sf):
    c = positions.clean_points(_as_text(points(spark, sf)))
    return c.select("mmsi", sec("base_date_time").alias("t"), "longitude", "latitude", "sog")


@check(
    "points_of_vessels",
    f"{with_points()} SELECT mmsi, {I('t')} AS t, src_id FROM p WHERE mmsi IN (SELECT mmsi FROM p WHERE sog >= 39.5)",
)
def _(spark, sf):
    p = points(spark, sf)
    fast = p.where("sog >= 39.5").select("mmsi")
    return positions.points_of_vessels(p, fast).select("mmsi", sec("base_date_time").alias("t"), "src_id")


@check(
    "explode_segments",
    f"{with_points(SEGMENTS_SQL)} SELECT mmsi, {I('segment_id')} AS segment_id, {I('t')} AS t, lon, lat FROM sg "
    "WHERE t2 IS NOT NULL OR t0 IS NOT NULL",
)
def _(spark, sf):
    s = trips.explode_segments(trips.build_segments(points(spark, sf)))
    return s.select("mmsi", "segment_id", sec("ts").alias("t"), "lon", "lat")


_BOX_SQL = (
    "bx AS (SELECT mmsi, min(lon) x1, max(lon) x2, min(lat) y1, max(lat) y2 FROM op GROUP BY mmsi)"
)


def _boxes(p):
    return p.where("longitude is not null and latitude is not null").groupBy("mmsi").agg(
        F.min("longitude").alias("bbox_min_lon"), F.max("longitude").alias("bbox_max_lon"),
        F.min("latitude").alias("bbox_min_lat"), F.max("latitude").alias("bbox_max_lat"),
    )


@check(
    "zones_from_geojson",
    f"""{with_points(_BOX_SQL)} SELECT {I('mmsi - 200000000')} AS zone_id,
    CASE WHEN mmsi % 3 = 0 THEN 'area ' || mmsi ELSE '禁区' || (mmsi - 200000000) END AS name,
    x1 AS xmin, x2 AS xmax, y1 AS ymin, y2 AS ymax, {I('3')} AS n_edges FROM bx WHERE mmsi % 3 <> 2""",
)
def _(spark, sf):
    x1, x2, y1, y2 = ("bbox_min_lon", "bbox_max_lon", "bbox_min_lat", "bbox_max_lat")
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y1))])
    geom = lambda kind: F.struct(F.lit(kind).alias("type"), F.array(ring).alias("coordinates"))
    named = F.to_json(F.struct(F.concat(F.lit("area "), F.col("mmsi").cast("string")).alias("name"), geom("Polygon").alias("geometry")))
    text = F.when(F.col("mmsi") % 3 == 0, named).when(F.col("mmsi") % 3 == 1, F.to_json(geom("Polygon"))).otherwise(F.to_json(geom("Point")))
    src = _boxes(points(spark, sf)).select((F.col("mmsi") - 200000000).alias("ordinal"), text.alias("geojson"))
    z = zone_source.zones_from_geojson(src)
    return z.select(F.col("zone_id").cast("long").alias("zone_id"), "name", "box.*", F.size("edges").cast("long").alias("n_edges"))


# --- SNK ------------------------------------------------------------------------


@check(
    "append_points",
    f"""{with_points()} SELECT mmsi, {I('t')} AS t, src_id FROM p
    WHERE (mmsi, t) NOT IN (SELECT mmsi, t FROM p WHERE t < {T0})
    QUALIFY row_number() OVER (PARTITION BY mmsi, t ORDER BY src_id) = 1""",
)
def _(spark, sf):
    p = points(spark, sf)
    old = p.where(sec("base_date_time") < T0)
    return sinks.append_points(p, old).select("mmsi", sec("base_date_time").alias("t"), "src_id")


_LITERAL = (
    "'{' || string_agg('POINT(' || printf('%.6f', lon) || ' ' || printf('%.6f', lat) || ')@' "
    "|| strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') || '+00', ',' ORDER BY t) || '}'"
)
_SEG_HASH = f"""sh AS (
  SELECT mmsi, segment_id, count(*) AS n_points, md5({_LITERAL}) AS trip_hash,
    arg_min(sog, t) AS sog, arg_min(coalesce(vessel_name, ''), t) AS vessel_name, min(t) AS t_first
  FROM sg GROUP BY mmsi, segment_id HAVING count(*) >= 2
)"""


@check(
    "build_segments",
    f"""{with_points(SEGMENTS_SQL, _SEG_HASH)} SELECT h.mmsi, {I('h.segment_id')} AS segment_id,
    {I('h.n_points')} AS n_points, h.trip_hash, s.sog, s.vessel_name, s.imo, {I('s.status')} AS status
    FROM sh h JOIN sg s ON s.mmsi = h.mmsi AND s.t = h.t_first""",
)
def _(spark, sf):
    s = trips.build_segments(points(spark, sf))
    return s.select(
        "mmsi", "segment_id", F.col("n_points").cast("long").alias("n_points"), "trip_hash", "sog", "vessel_name",
        "imo", F.col("status").cast("long").alias("status"),
    )


@check(
    "append_segments",
    f"""{with_points(SEGMENTS_SQL, _SEG_HASH)} SELECT mmsi, {I('segment_id')} AS segment_id, trip_hash FROM sh
    WHERE segment_id % 2 = 0""",
)
def _(spark, sf):
    s = trips.build_segments(points(spark, sf)).drop("points")
    return sinks.append_segments(s, s.where("segment_id % 2 = 1")).select("mmsi", "segment_id", "trip_hash")


@check(
    "dedupe_points",
    f"""{with_points()} SELECT mmsi, {I('t')} AS t, src_id, vessel_name FROM p
    QUALIFY row_number() OVER (PARTITION BY mmsi, t ORDER BY src_id DESC) = 1""",
)
def _(spark, sf):
    return sinks.dedupe_points(points(spark, sf)).select("mmsi", sec("base_date_time").alias("t"), "src_id", "vessel_name")


@check("write_points", f"{with_points()} SELECT mmsi, {I('t')} AS t, src_id, lon, lat, sog FROM p")
def _(spark, sf):
    path = scratch(spark) + "/points"
    p = points(spark, sf)
    sinks.write_points(p.where("src_id % 2 = 0"), path)
    sinks.write_points(p, path, mode="overwrite")
    return spark.read.parquet(path).select(
        "mmsi", sec("base_date_time").alias("t"), "src_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "sog"
    )


@check(
    "bbox_to_geojson",
    f"""{with_points(_BOX_SQL)} SELECT mmsi, '{{"type":"Polygon","coordinates":[[[' || x1 || ',' || y1 || '],[' || x1 || ',' || y2
    || '],[' || x2 || ',' || y2 || '],[' || x2 || ',' || y1 || '],[' || x1 || ',' || y1 || ']]]}}' AS geojson FROM bx""",
)
def _(spark, sf):
    return sinks.bbox_to_geojson(_boxes(points(spark, sf))).select("mmsi", "geojson")


@check(
    "to_geojson",
    f"""{with_points()} SELECT mmsi, {I('count(*)')} AS n_points,
    '{{"type":"LineString","coordinates":[' || string_agg('[' || lon || ',' || lat || ']', ',' ORDER BY t) || ']}}' AS geojson
    FROM op GROUP BY mmsi""",
)
def _(spark, sf):
    p = trips.track_lines(points(spark, sf))
    return sinks.to_geojson(p).withColumn("n_points", F.col("n_points").cast("long"))


# --- V --------------------------------------------------------------------------

_NEWEST = "QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, src_id DESC) = 1"


@check(
    "search_vessels",
    f"""{with_points()} SELECT mmsi, vessel_name, {I('vessel_type')} AS vessel_type, {I('t')} AS t FROM (
    SELECT * FROM p WHERE lower(vessel_name) LIKE 'vessel 1%' {_NEWEST}) ORDER BY mmsi LIMIT 20""",
)
def _(spark, sf):
    v = registry.search_vessels(points(spark, sf), "Vessel 1")
    return v.select("mmsi", "vessel_name", F.col("vessel_type").cast("long").alias("vessel_type"), sec("base_date_time").alias("t"))


@check(
    "search_vessels_by_number",
    f"""{with_points()} SELECT mmsi, vessel_name, {I('t')} AS t FROM (
    SELECT * FROM p WHERE CAST(mmsi AS VARCHAR) LIKE '2000000%' {_NEWEST}) ORDER BY mmsi LIMIT 20""",
)
def _(spark, sf):
    v = registry.search_vessels(points(spark, sf), "2000000")
    return v.select("mmsi", "vessel_name", sec("base_date_time").alias("t"))


@check(
    "latest_state",
    f"""{with_points()} SELECT mmsi, {I('t')} AS t, src_id, CASE WHEN lat IS NOT NULL THEN lon END AS lon,
    CASE WHEN lon IS NOT NULL THEN lat END AS lat, sog, cog, heading, vessel_name, imo, call_sign,
    {I('status')} AS status, length, width, draft, transceiver FROM (SELECT * FROM p {_NEWEST})""",
)
def _(spark, sf):
    v = registry.latest_state(points(spark, sf))
    return v.select(
        "mmsi", sec("base_date_time").alias("t"), "src_id", "position.lon", "position.lat", "sog", "cog", "heading",
        "vessel_name", "imo", "call_sign", F.col("status").cast("long").alias("status"), "length", "width", "draft", "transceiver",
    )


@check(
    "list_vessels",
    f"""{with_points()} SELECT mmsi, vessel_name, {I('t')} AS t,
    (SELECT count(DISTINCT mmsi) FROM p WHERE vessel_type = 70) AS total
    FROM (SELECT * FROM p WHERE vessel_type = 70 {_NEWEST}) ORDER BY mmsi LIMIT 10 OFFSET 10""",
)
def _(spark, sf):
    v = registry.list_vessels(points(spark, sf), page=2, page_size=10, vessel_type=70)
    return v.select("mmsi", "vessel_name", sec("base_date_time").alias("t"), "total")


@check(
    "fleet_center",
    f"""{with_points()} SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat,
    {Q('(min(lon) + max(lon)) / 2')} AS center_lon, {Q('(min(lat) + max(lat)) / 2')} AS center_lat FROM op""",
)
def _(spark, sf):
    c = registry.fleet_center(points(spark, sf))
    return c.select("min_lon", "max_lon", "min_lat", "max_lat", q("center_lon").alias("center_lon"), q("center_lat").alias("center_lat"))


@check(
    "decode_codes",
    f"""{with_points()} SELECT src_id, CASE vessel_type WHEN 30 THEN '渔船' WHEN 60 THEN '客船' WHEN 70 THEN '货船'
    WHEN 80 THEN '油轮' WHEN 0 THEN '其他' END AS vessel_type_label, CASE status WHEN 0 THEN '航行中' WHEN 1 THEN '锚泊'
    WHEN 2 THEN '失控' WHEN 3 THEN '受限' WHEN 5 THEN '系泊' WHEN 15 THEN '未定义' END AS status_label FROM p""",
)
def _(spark, sf):
    return registry.decode_codes(points(spark, sf)).select("src_id", "vessel_type_label", "status_label")


# --- D --------------------------------------------------------------------------

_X1, _Y1, _X2, _Y2 = (f"{v!r}::DOUBLE" for v in VIEWPORT)


def _view(granularity: int, where: str) -> str:
    row = f"CAST(floor((lat - {_Y1}) / (({_Y2} - {_Y1}) / {granularity})) AS BIGINT)"
    col = f"CAST(floor((lon - {_X1}) / (({_X2} - {_X1}) / {granularity})) AS BIGINT)"
    return f"""vw AS (SELECT * FROM (SELECT mmsi, lon, lat, {row} AS "row", {col} AS col FROM p
      WHERE lat BETWEEN {_Y1} AND {_Y2} AND lon BETWEEN {_X1} AND {_X2} AND {where})
      WHERE "row" BETWEEN 0 AND {granularity - 1} AND col BETWEEN 0 AND {granularity - 1})"""


@check(
    "viewport_heatmap",
    f"""{with_points(_view(60, f't BETWEEN {T0} AND {T1}'))}, g AS (SELECT "row", col, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon
    FROM vw GROUP BY "row", col) SELECT "row", col, {I('n')} AS n_points, {Q('lat')} AS lat, {Q('lon')} AS lon,
    {Q('least(ln(n + 1.0::DOUBLE) / nullif(ln((SELECT max(n) FROM g) + 1.0::DOUBLE), 0), 1.0)')} AS intensity
    FROM g ORDER BY n DESC, "row", col LIMIT 2000""",
)
def _(spark, sf):
    h = density.viewport_heatmap(points(spark, sf), VIEWPORT, START, END)
    return h.select("row", "col", "n_points", q("lat").alias("lat"), q("lon").alias("lon"), q("intensity").alias("intensity"))


@check(
    "vessel_density",
    f"""{with_points(_view(30, 'TRUE'))}, v AS (SELECT mmsi, "row", col, avg(lat) AS lat, avg(lon) AS lon FROM vw GROUP BY ALL),
    g AS (SELECT "row", col, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM v GROUP BY "row", col)
    SELECT "row", col, {Q('lat')} AS lat, {Q('lon')} AS lon, {I('n')} AS vessels,
    {Q('least(n::DOUBLE / nullif((SELECT max(n) FROM g), 0), 1.0)')} AS intensity FROM g ORDER BY n DESC, "row", col LIMIT 500""",
)
def _(spark, sf):
    h = density.vessel_density(points(spark, sf), VIEWPORT)
    return h.select("row", "col", "vessels", q("lat").alias("lat"), q("lon").alias("lon"), q("intensity").alias("intensity"))


@check(
    "space_time_density",
    f"""{with_points()}, g AS (SELECT {cell('lon', 0.01)} AS cell_x, {cell('lat', 0.01)} AS cell_y, t // 3600 * 3600 AS time_bucket,
    count(*) AS n, count(DISTINCT mmsi) AS vessels, avg(lon) AS lon, avg(lat) AS lat FROM op
    WHERE t BETWEEN {T0} AND {T1} GROUP BY 1, 2, 3 HAVING count(*) > 1)
    SELECT cell_x, cell_y, {I('time_bucket')} AS time_bucket, {I('n')} AS n_points, {I('vessels')} AS vessels,
    {Q('lon')} AS avg_lon, {Q('lat')} AS avg_lat, {Q('least(1.0, n / 100.0::DOUBLE)')} AS intensity
    FROM g ORDER BY n DESC, time_bucket, cell_x, cell_y LIMIT 1000""",
)
def _(spark, sf):
    d = density.space_time_density(points(spark, sf), start=START, end=END)
    return d.select(
        "cell_x", "cell_y", sec("time_bucket").alias("time_bucket"), "n_points", "vessels",
        q("avg_lon").alias("avg_lon"), q("avg_lat").alias("avg_lat"), q("intensity").alias("intensity"),
    )


@check(
    "corridors",
    f"""{with_points(TRIPS_SQL)}, g AS (SELECT {cell('lon', 0.05)} AS x1, {cell('lat', 0.05)} AS y1, {cell('lon2', 0.05)} AS x2,
    {cell('lat2', 0.05)} AS y2, count(*) AS n, count(DISTINCT mmsi) AS v,
    avg(sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)) * 111000) AS m, avg(t2 - t) AS s
    FROM tr WHERE t2 IS NOT NULL AND (abs(lon2 - lon) > 0.0001::DOUBLE OR abs(lat2 - lat) > 0.0001::DOUBLE)
    GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT mmsi) >= 3)
    SELECT x1, y1, x2, y2, {I('n')} AS passages, {I('v')} AS vessels, {Q('m', 3)} AS avg_length_m, {Q('s', 3)} AS avg_duration_s,
    {Q('m / s * 1.94384::DOUBLE')} AS avg_speed_kn,
    {Q('CASE WHEN x1 <> x2 OR y1 <> y2 THEN (degrees(atan2((x2 - x1)::DOUBLE, (y2 - y1)::DOUBLE)) + 360) % 360 END')} AS direction,
    {Q('least(1.0, v / 50.0::DOUBLE)')} AS intensity
    FROM g ORDER BY v DESC, n DESC, x1, y1, x2, y2 LIMIT 500""",
)
def _(spark, sf):
    d = density.corridors(points(spark, sf), grid_size=0.05, min_vessels=3)
    return d.select(
        "x1", "y1", "x2", "y2", "passages", "vessels", q("avg_length_m", 3).alias("avg_length_m"),
        q("avg_duration_s", 3).alias("avg_duration_s"), q("avg_speed_kn").alias("avg_speed_kn"),
        q("direction").alias("direction"), q("intensity").alias("intensity"),
    )


@check(
    "speed_grid",
    f"""{with_points(TRIPS_SQL)}, v AS (SELECT mmsi, nk, sum({hav('lon', 'lat', 'lon2', 'lat2')}) / sum(t2 - t) AS v,
    (arg_min(lon, t) + arg_max(lon, t)) / 2 AS x, (arg_min(lat, t) + arg_max(lat, t)) / 2 AS y FROM tr GROUP BY mmsi, nk),
    g AS (SELECT {cell('x', 0.1)} AS cell_x, {cell('y', 0.1)} AS cell_y, avg(v) * 1.94384::DOUBLE AS kn, count(*) AS n,
    stddev_samp(v) * 1.94384::DOUBLE AS sd FROM v WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT cell_x, cell_y, {Q('kn')} AS avg_speed_kn, {I('n')} AS trips, {Q('sd', 5)} AS speed_std_kn FROM g
    ORDER BY kn DESC, cell_x, cell_y LIMIT 500""",
)
def _(spark, sf):
    d = density.speed_grid(points(spark, sf), grid_size=0.1)
    return d.select("cell_x", "cell_y", q("avg_speed_kn").alias("avg_speed_kn"), "trips", q("speed_std_kn", 5).alias("speed_std_kn"))


@check(
    "time_distribution",
    f"""{with_points()} SELECT {I('t // 1800 * 1800')} AS time_bucket, {I('count(*)')} AS n_points,
    {I('count(DISTINCT mmsi)')} AS vessels FROM op GROUP BY 1""",
)
def _(spark, sf):
    d = density.time_distribution(points(spark, sf), bucket_s=1800)
    return d.select(sec("time_bucket").alias("time_bucket"), "n_points", "vessels")


# --- E --------------------------------------------------------------------------

_STOPS = f"""st AS (SELECT mmsi, segment_id, min(t) AS t1, max(t) AS t2, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n,
  stddev_samp(lat) + stddev_samp(lon) AS spread FROM sg GROUP BY mmsi, segment_id
  HAVING stddev_samp(lat) + stddev_samp(lon) <= 500 / 111000.0::DOUBLE AND max(t) - min(t) >= 1800)"""


@check(
    "detect_stops",
    f"""{with_points(SEGMENTS_SQL, _STOPS)} SELECT mmsi, {I('segment_id')} AS segment_id, {I('t1')} AS t1, {I('t2')} AS t2,
    {Q('lon')} AS lon, {Q('lat')} AS lat, {I('n')} AS n_points, {Q('(t2 - t1) / 60.0::DOUBLE')} AS duration_min FROM st""",
)
def _(spark, sf):
    s = events.detect_stops(points(spark, sf))
    return s.select(
        "mmsi", "segment_id", sec("start_time").alias("t1"), sec("end_time").alias("t2"), q("lon").alias("lon"),
        q("lat").alias("lat"), "n_points", q("duration_min").alias("duration_min"),
    )


@check(
    "stop_totals",
    f"""{with_points(SEGMENTS_SQL, _STOPS)} SELECT mmsi, {I('count(*)')} AS n_stops,
    {Q('sum((t2 - t1) / 60.0::DOUBLE)')} AS total_duration_min FROM st GROUP BY mmsi""",
)
def _(spark, sf):
    s = events.stop_totals(events.detect_stops(points(spark, sf)))
    return s.select("mmsi", "n_stops", q("total_duration_min").alias("total_duration_min"))


_OVERSPEED = "ov AS (SELECT mmsi, t, lon, lat, sog, least(0.4::DOUBLE + (sog - 30) / 20, 1.0) AS score FROM op WHERE sog >= 30)"


@check(
    "overspeed_events",
    f"{with_points(_OVERSPEED)} SELECT mmsi, {I('t')} AS t, lon, lat, sog, {Q('score')} AS score FROM ov",
)
def _(spark, sf):
    o = events.overspeed_events(points(spark, sf))
    return o.select("mmsi", sec("ts").alias("t"), "lon", "lat", "sog", q("score").alias("score"))


def severity_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 0.8::DOUBLE THEN 'high' WHEN {score} >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END"


@check("severity", f"{with_points(_OVERSPEED)} SELECT mmsi, {I('t')} AS t, {severity_sql('score')} AS severity FROM ov")
def _(spark, sf):
    o = events.overspeed_events(points(spark, sf))
    return o.select("mmsi", sec("ts").alias("t"), events.severity("score").alias("severity"))


_TURNS = """tn AS (
  SELECT *, least(pmod, 360 - pmod) / dt_min AS rate, least(pmod, 360 - pmod) AS turn FROM (
    SELECT *, abs(cog - cog0) % 360 AS pmod, (t - t0) / 60.0::DOUBLE AS dt_min FROM (
      SELECT mmsi, t, lon, lat, cog, coalesce(sog, 0) AS sog, lag(t) OVER w AS t0, lag(cog) OVER w AS cog0,
             lag(coalesce(sog, 0)) OVER w AS sog0
      FROM op WINDOW w AS (PARTITION BY mmsi ORDER BY t))
    WHERE cog IS NOT NULL AND cog0 IS NOT NULL AND t > t0 AND (sog + sog0) / 2 >= 3)
), sharp AS (SELECT *, least(0.45::DOUBLE + (rate - 20) / 60, 1.0) AS score FROM tn WHERE rate >= 20)"""


@check(
    "sharp_turn_events",
    f"""{with_points(_TURNS)} SELECT mmsi, {I('t0')} AS t1, {I('t')} AS t2, lon, lat, {Q('turn')} AS turn_deg,
    {Q('rate')} AS turn_rate, {Q('score')} AS score FROM sharp""",
)
def _(spark, sf):
    e = events.sharp_turn_events(points(spark, sf))
    return e.select(
        "mmsi", sec("start_time").alias("t1"), sec("end_time").alias("t2"), "lon", "lat",
        q("turn_deg").alias("turn_deg"), q("turn_rate").alias("turn_rate"), q("score").alias("score"),
    )


# greedy anchors by recursion over the reports of each run
_ANCHORED = f"""sl_g AS (
  SELECT mmsi, t, lon, lat, coalesce(sog, 0) AS sog, lag(t) OVER w AS tp, lag(coalesce(sog, 0)) OVER w AS sp
  FROM op WINDOW w AS (PARTITION BY mmsi ORDER BY t)
), sl AS (
  SELECT *, sum(CASE WHEN tp IS NULL OR t - tp > 1800 OR sog > 1 OR sp > 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY mmsi ORDER BY t) AS run FROM sl_g
), rn AS (
  SELECT *, row_number() OVER (PARTITION BY mmsi, run ORDER BY t) AS i FROM sl WHERE sog <= 1
), walk AS (
  SELECT mmsi, run, i, t, lon, lat, lon AS ax, lat AS ay, i AS a FROM rn WHERE i = 1
  UNION ALL
  SELECT r.mmsi, r.run, r.i, r.t, r.lon, r.lat,
    CASE WHEN {hav('w.ax', 'w.ay', 'r.lon', 'r.lat')} > 500 THEN r.lon ELSE w.ax END,
    CASE WHEN {hav('w.ax', 'w.ay', 'r.lon', 'r.lat')} > 500 THEN r.lat ELSE w.ay END,
    CASE WHEN {hav('w.ax', 'w.ay', 'r.lon', 'r.lat')} > 500 THEN r.i ELSE w.a END
  FROM walk w JOIN rn r ON r.mmsi = w.mmsi AND r.run = w.run AND r.i = w.i + 1
), stay AS (
  SELECT *, least(0.5::DOUBLE + minutes / 240, 1.0) AS score FROM (
    SELECT mmsi, min(t) AS t1, max(t) AS t2, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n,
      (max(t) - min(t)) / 60.0::DOUBLE AS minutes
    FROM walk GROUP BY mmsi, run, a HAVING count(*) > 1 AND max(t) - min(t) >= 1800)
)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@check(
    "abnormal_stops",
    recursive(
        f"""{with_points(_ANCHORED)} SELECT mmsi, {I('t1')} AS t1, {I('t2')} AS t2, {Q('lon')} AS lon, {Q('lat')} AS lat,
        {I('n')} AS n_points, {Q('minutes')} AS duration_min, {Q('score')} AS score FROM stay"""
    ),
)
def _(spark, sf):
    e = events.abnormal_stops(points(spark, sf))
    return e.select(
        "mmsi", sec("start_time").alias("t1"), sec("end_time").alias("t2"), q("lon").alias("lon"), q("lat").alias("lat"),
        "n_points", q("duration_min").alias("duration_min"), q("score").alias("score"),
    )


_FEED = f"""feed AS (SELECT *, {severity_sql('score')} AS severity FROM (
  SELECT mmsi, 'overspeed' AS event_type, t AS t1, t AS t2, lon, lat, score, NULL AS zone_name FROM ov
  UNION ALL SELECT mmsi, 'sharp_turn', t0, t, lon, lat, score, NULL FROM sharp
  UNION ALL SELECT mmsi, 'abnormal_stop', t1, t2, lon, lat, score, NULL FROM stay
  UNION ALL SELECT mmsi, 'forbidden_area_entry', min(t), max(t), avg(lon), avg(lat),
    least(0.6::DOUBLE + count(*) / 200.0::DOUBLE, 1.0), zone_name FROM zp GROUP BY mmsi, zone_name)
  WHERE mmsi IN (SELECT mmsi FROM op GROUP BY mmsi HAVING count(*) >= 2))"""
_FEED_CTES = (_OVERSPEED, _TURNS, _ANCHORED, zones_sql(), _FEED)


@check(
    "detect_anomalies",
    recursive(
        f"""{with_points(*_FEED_CTES)} SELECT mmsi, event_type, severity, {Q('score')} AS score, {I('t1')} AS t1,
        {I('t2')} AS t2, {Q('lon')} AS lon, {Q('lat')} AS lat, zone_name FROM feed"""
    ),
)
def _(spark, sf):
    e = events.detect_anomalies(points(spark, sf), zones(spark))
    return e.select(
        "mmsi", "event_type", "severity", q("score").alias("score"), sec("start_time").alias("t1"),
        sec("end_time").alias("t2"), q("position.lon").alias("lon"), q("position.lat").alias("lat"), "zone_name",
    )


@check(
    "anomaly_summary",
    recursive(
        f"""{with_points(*_FEED_CTES)} SELECT mmsi, {I('count(*)')} AS n_events,
        {I("count(*) FILTER (severity = 'high')")} AS high, {I("count(*) FILTER (severity = 'medium')")} AS medium,
        {I("count(*) FILTER (severity = 'low')")} AS low FROM feed GROUP BY mmsi"""
    ),
)
def _(spark, sf):
    return events.anomaly_summary(events.detect_anomalies(points(spark, sf), zones(spark)))


@check(
    "anomaly_types",
    recursive(f"{with_points(*_FEED_CTES)} SELECT event_type, {I('count(*)')} AS n_events FROM feed GROUP BY event_type"),
)
def _(spark, sf):
    return events.anomaly_types(events.detect_anomalies(points(spark, sf), zones(spark)))
