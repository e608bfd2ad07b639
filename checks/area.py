"""Zones, ports and space-time retrieval."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import (
    END, I, Q, START, T0, T1, VTRIPS_SQL, ZONES, check, inside_sql, points, ports, ports_sql, q, ring_sql,
    sec, with_points, zones, zones_sql,
)
from checks.fleet import _BOX_SQL, _boxes
from seawake.functions.geo import mbb_contains, mbb_intersects, mbb_volume, point_in_ring
from seawake.operators import retrieval, trips
from seawake.operators import zones as zone_ops

_RINGS = [z["geometry"]["coordinates"][0] for z in ZONES]


@check(
    "point_in_ring",
    f"""{with_points()} SELECT src_id, coalesce({inside_sql('lon', 'lat', _RINGS[0])}, FALSE) AS in_a,
    coalesce({inside_sql('lon', 'lat', _RINGS[1])}, FALSE) AS in_b FROM p""",
)
def _(spark, sf):
    ring = lambda r: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r])
    return points(spark, sf).select(
        "src_id", *[point_in_ring("longitude", "latitude", ring(r)).alias(n) for n, r in zip(("in_a", "in_b"), _RINGS)]
    )


def _meets(ring: list) -> str:
    side = lambda ax, ay, bx, by, px, py: f"sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"
    cuts = []
    for e in ring_sql(ring):
        a, b, c, d = (f"{v!r}::DOUBLE" for v in e)
        cuts.append(
            f"(greatest(x1, x2) >= least({a}, {c}) AND least(x1, x2) <= greatest({a}, {c})"
            f" AND greatest(y1, y2) >= least({b}, {d}) AND least(y1, y2) <= greatest({b}, {d})"
            f" AND {side(a, b, c, d, 'x1', 'y1')} * {side(a, b, c, d, 'x2', 'y2')} <= 0"
            f" AND {side('x1', 'y1', 'x2', 'y2', a, b)} * {side('x1', 'y1', 'x2', 'y2', c, d)} <= 0)"
        )
    return f"({inside_sql('x1', 'y1', ring, False)} OR {inside_sql('x2', 'y2', ring, False)} OR {' OR '.join(cuts)})"


def _clip(axis: str, t: str) -> str:
    return f"{axis} + ({axis}2 - {axis}) * (({t} - t) / (t2 - t)::DOUBLE)"


_ENTERED = f"""pc AS (
  SELECT mmsi, {_clip('lon', f'greatest(t, {T0})')} AS x1, {_clip('lat', f'greatest(t, {T0})')} AS y1,
    {_clip('lon', f'least(t2, {T1})')} AS x2, {_clip('lat', f'least(t2, {T1})')} AS y2
  FROM vt WHERE t2 IS NOT NULL AND t < {T1} AND t2 > {T0}
  UNION ALL SELECT mmsi, lon, lat, lon, lat FROM vt WHERE t BETWEEN {T0} AND {T1} AND (t2 IS NULL OR t = {T1})
), en AS (
  {' UNION '.join(f"SELECT DISTINCT mmsi, {i} AS zone_id, '{z['name']}' AS zone_name FROM pc WHERE {_meets(r)}" for i, (z, r) in enumerate(zip(ZONES, _RINGS), 1))}
), sy AS (
  SELECT z.mmsi, zone_id, min(z.t) AS t1, max(z.t) AS t2, count(*) AS n, sum(z.lon) AS sx FROM zp z JOIN op USING (src_id)
  WHERE z.t BETWEEN {T0} AND {T1} GROUP BY z.mmsi, zone_id
)"""


@check(
    "area_detection",
    f"""{with_points(VTRIPS_SQL, zones_sql(), _ENTERED)} SELECT mmsi, {I('zone_id')} AS zone_id, zone_name, {I('t1')} AS t1, {I('t2')} AS t2,
    {Q('(t2 - t1) / 60.0::DOUBLE')} AS stay_minutes, {I('coalesce(n, 0)')} AS n_inside,
    {I('CASE WHEN n >= 2 THEN n END')} AS n_track, {Q('CASE WHEN n >= 2 THEN sx END', 4)} AS sum_lon
    FROM en LEFT JOIN sy USING (mmsi, zone_id)""",
)
def _(spark, sf):
    a = zone_ops.area_detection(points(spark, sf), zones(spark), START, END)
    track = F.col("inside_track")
    return a.select(
        "mmsi", F.col("zone_id").cast("long").alias("zone_id"), "zone_name", sec("enter_time").alias("t1"),
        sec("exit_time").alias("t2"), q("stay_minutes").alias("stay_minutes"), "n_inside",
        F.when(track.isNotNull(), F.size(track)).cast("long").alias("n_track"),
        q(F.aggregate(track, F.lit(0.0), lambda s, r: s + r["lon"]), 4).alias("sum_lon"),
    )


@check(
    "zone_entries",
    f"""{with_points(zones_sql())} SELECT mmsi, {I('zone_id')} AS zone_id, zone_name, {I('count(*)')} AS n_points, {I('min(t)')} AS t1,
    {I('max(t)')} AS t2, {Q('avg(lon)')} AS lon, {Q('avg(lat)')} AS lat, {Q('least(0.6::DOUBLE + count(*) / 200.0::DOUBLE, 1.0)')} AS score
    FROM zp WHERE t BETWEEN {T0} AND {T1} GROUP BY mmsi, zone_id, zone_name""",
)
def _(spark, sf):
    z = zone_ops.zone_entries(points(spark, sf), zones(spark), START, END)
    return z.select(
        "mmsi", F.col("zone_id").cast("long").alias("zone_id"), "zone_name", "n_points", sec("start_time").alias("t1"),
        sec("end_time").alias("t2"), q("lon").alias("lon"), q("lat").alias("lat"), q("score").alias("score"),
    )


# stays by numbering entries and exits per (port, vessel) and pairing equal numbers
_STAYS = f"""{ports_sql()}, pin AS (
  SELECT port_id, mmsi, t, coalesce(lon > x1 AND lon < x2 AND lat > y1 AND lat < y2, FALSE) AS inside
  FROM op CROSS JOIN port WHERE t BETWEEN {T0} AND {T1}
), pl AS (
  SELECT *, coalesce(lag(inside) OVER (PARTITION BY port_id, mmsi ORDER BY t), FALSE) AS was FROM pin
), ent AS (
  SELECT port_id, mmsi, t, row_number() OVER (PARTITION BY port_id, mmsi ORDER BY t) AS k FROM pl WHERE inside AND NOT was
), ext AS (
  SELECT port_id, mmsi, t, row_number() OVER (PARTITION BY port_id, mmsi ORDER BY t) AS k FROM pl WHERE was AND NOT inside
), stay AS (
  SELECT e.port_id, e.mmsi, e.t AS t1, x.t AS t2, greatest((coalesce(x.t, {T1}) - e.t) / 60.0::DOUBLE, 0) AS minutes
  FROM ent e LEFT JOIN ext x USING (port_id, mmsi, k)
)"""


@check(
    "port_analysis",
    f"""{with_points(_STAYS)} SELECT {I('port_id')} AS port_id, port_name,
    (SELECT {I('count(DISTINCT mmsi)')} FROM pl WHERE inside AND pl.port_id = port.port_id) AS vessels,
    (SELECT {I('count(*)')} FROM ent WHERE ent.port_id = port.port_id) AS entries,
    (SELECT {I('count(*)')} FROM ext WHERE ext.port_id = port.port_id) AS exits,
    coalesce((SELECT {Q('sum(minutes)', 4)} FROM stay WHERE stay.port_id = port.port_id), 0) AS total_stay_minutes,
    coalesce((SELECT {Q('avg(minutes)', 4)} FROM stay WHERE stay.port_id = port.port_id), 0) AS avg_stay_minutes FROM port""",
)
def _(spark, sf):
    a = zone_ops.port_analysis(points(spark, sf), ports(spark), START, END)
    return a.select(
        "port_id", "port_name", "vessels", "entries", "exits", q("total_stay_minutes", 4).alias("total_stay_minutes"),
        q("avg_stay_minutes", 4).alias("avg_stay_minutes"),
    )


@check(
    "port_stays",
    f"""{with_points(_STAYS)} SELECT {I('port_id')} AS port_id, mmsi, {I('t1')} AS entry_t, {I('t2')} AS exit_t,
    {Q('minutes')} AS stay_minutes FROM stay""",
)
def _(spark, sf):
    s = zone_ops.port_stays(points(spark, sf), ports(spark), START, END)
    return s.select("port_id", "mmsi", sec("entry_time").alias("entry_t"), sec("exit_time").alias("exit_t"), q("stay_minutes").alias("stay_minutes"))


@check(
    "port_top_vessels",
    f"""{with_points(_STAYS)}, tot AS (SELECT port_id, mmsi, sum(minutes) AS m, count(*) AS n FROM stay GROUP BY port_id, mmsi),
    rk AS (SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY m DESC, n DESC, mmsi) AS r FROM tot),
    nm AS (SELECT mmsi, vessel_name FROM p WHERE vessel_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY t DESC, src_id DESC) = 1)
    SELECT {I('port_id')} AS port_id, {I('r')} AS rank, mmsi, vessel_name, {Q('m')} AS stay_minutes, {I('n')} AS visits
    FROM rk LEFT JOIN nm USING (mmsi) WHERE r <= 5""",
)
def _(spark, sf):
    t = zone_ops.port_top_vessels(points(spark, sf), ports(spark), START, END)
    return t.select("port_id", F.col("rank").cast("long").alias("rank"), "mmsi", "vessel_name", q("stay_minutes").alias("stay_minutes"), "visits")


def _berths(spark, sf):
    """The area of each vessel as a port; vessels that never move have an empty box."""
    b = _boxes(points(spark, sf))
    return zone_ops.ports_from_bboxes(
        b.withColumnRenamed("mmsi", "id")
        .withColumn("name", F.concat(F.lit(" Berth "), F.col("id").cast("string"), F.lit(" ")))
        .withColumn("created_at", F.timestamp_seconds(F.col("id") % 97))
    )


@check(
    "ports_from_bboxes",
    f"""{with_points(_BOX_SQL)} SELECT mmsi AS id, 'Berth ' || mmsi AS name, {I('5')} AS n_ring, x1 AS x_first, y1 AS y_first, x2 AS x_third, y2 AS y_third
    FROM bx WHERE x1 < x2 AND y1 < y2""",
)
def _(spark, sf):
    r = F.col("ring")
    return _berths(spark, sf).select(
        "id", "name", F.size("ring").cast("long").alias("n_ring"), r[0]["x"].alias("x_first"), r[0]["y"].alias("y_first"),
        r[2]["x"].alias("x_third"), r[2]["y"].alias("y_third"),
    )


@check(
    "list_ports",
    f"""{with_points(_BOX_SQL)}, l AS (SELECT mmsi AS id, 'Berth ' || mmsi AS name FROM bx WHERE x1 < x2 AND y1 < y2 AND 'Berth ' || mmsi ILIKE '%bErTh 2000000%')
    SELECT id, name, (SELECT count(*) FROM l) AS total FROM l ORDER BY id % 97 DESC, id DESC LIMIT 10 OFFSET 10""",
)
def _(spark, sf):
    return zone_ops.list_ports(_berths(spark, sf), "bErTh 2000000", page=2, page_size=10).select("id", "name", "total")


# --- R --------------------------------------------------------------------------


def _summaries(spark, sf):
    return trips.trip_summary(trips.build_trips(points(spark, sf), numbered=False))


_SUM = """sm AS (SELECT mmsi, nk, min(t) AS t1, max(t) AS t2, min(lon) AS x1, max(lon) AS x2, min(lat) AS y1, max(lat) AS y2
  FROM (SELECT *, coalesce('=' || vessel_name, '') AS nk FROM op) GROUP BY mmsi, nk)"""
_QBOX = """qb AS (SELECT vessel_type * 100 + (t - 1735689600) // 3600 AS box_id, min(t) AS t1, max(t) AS t2, avg(lon) - 0.05::DOUBLE AS x1,
  avg(lon) + 0.05::DOUBLE AS x2, avg(lat) - 0.05::DOUBLE AS y1, avg(lat) + 0.05::DOUBLE AS y2 FROM op WHERE status = 2 GROUP BY 1)"""
_RANGE_SQL = f"""{with_points(_SUM, _QBOX)} SELECT DISTINCT {I('box_id')} AS box_id, s.mmsi FROM qb b JOIN sm s
  ON s.x1 <= b.x2 AND s.x2 >= b.x1 AND s.y1 <= b.y2 AND s.y2 >= b.y1 AND s.t1 <= b.t2 AND s.t2 >= b.t1"""


def _query_boxes(spark, sf):
    """Where vessels of each type were restricted in each hour: one box around the mean position."""
    p = trips.ordered_points(points(spark, sf)).where("status = 2")
    hour = F.floor((sec("base_date_time") - 1735689600) / 3600)
    g = p.groupBy((F.col("vessel_type") * 100 + hour).alias("box_id")).agg(
        F.avg("longitude").alias("x"), F.avg("latitude").alias("y"), F.min("base_date_time").alias("tmin"), F.max("base_date_time").alias("tmax")
    )
    sides = [(F.col(c) + d).alias(n) for c, d, n in (("x", -0.05, "xmin"), ("x", 0.05, "xmax"), ("y", -0.05, "ymin"), ("y", 0.05, "ymax"))]
    return g.select("box_id", F.struct(*sides, "tmin", "tmax").alias("box"))


@check("range_query", _RANGE_SQL)
def _(spark, sf):
    return retrieval.range_query(_summaries(spark, sf), _query_boxes(spark, sf))


@check("range_query_unpruned", _RANGE_SQL)
def _(spark, sf):
    return retrieval.range_query(_summaries(spark, sf), _query_boxes(spark, sf), pruned=False)


_ASKED = [(1, 121.5, 30.7, 6), (2, 123.0, 31.4, 9), (3, 100.0, 10.0, 3)]
_ASKED_SQL = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {1735689600 + h * 3600})" for i, x, y, h in _ASKED)


def _knn_sql(asked: str) -> str:
    return f"""{asked}, lv(r) AS (SELECT 0.1::DOUBLE * (1 << i) FROM range(11) g(i)),
    cd AS (SELECT query_id, mmsi, min(greatest(x1 - x, 0, x - x2, y1 - y, y - y2)) AS reach,
      min(sqrt(pow(greatest(x1 - x, 0, x - x2), 2) + pow(greatest(y1 - y, 0, y - y2), 2) + pow(greatest(t1 - t, 0, t - t2) / 3600.0::DOUBLE, 2))) AS d
      FROM aq JOIN sm ON t1 <= t + 3600 AND t2 >= t - 3600 GROUP BY query_id, mmsi),
    hit AS (SELECT query_id, r, count(*) AS n FROM cd JOIN lv ON reach <= r GROUP BY query_id, r),
    stop AS (SELECT query_id, coalesce(min(r) FILTER (n >= 10), max(r)) AS r FROM hit GROUP BY query_id),
    rk AS (SELECT query_id, mmsi, d, row_number() OVER (PARTITION BY query_id ORDER BY d, mmsi) AS k FROM cd JOIN stop USING (query_id) WHERE reach <= r)
    SELECT {I('query_id')} AS query_id, {I('k')} AS rank, mmsi, {Q('d')} AS distance FROM rk WHERE k <= 10"""


def _nearest(spark, sf, asked):
    k = retrieval.knn_query(_summaries(spark, sf), asked, k=10)
    return k.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), "mmsi", q("distance").alias("distance"))


@check("knn_query", _knn_sql(f"{with_points(_SUM)}, aq(query_id, x, y, t) AS (VALUES {_ASKED_SQL})"))
def _(spark, sf):
    day = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    return _nearest(spark, sf, [(i, x, y, day + dt.timedelta(hours=h)) for i, x, y, h in _ASKED])


_EVERY_100TH = "src_id % 100 = 0"


@check(
    "knn_join",
    _knn_sql(f"{with_points(_SUM)}, aq AS (SELECT src_id AS query_id, lon AS x, lat AS y, t FROM op WHERE {_EVERY_100TH})"),
)
def _(spark, sf):
    """The nearest vessels to every report whose number is divisible by 100, among all."""
    p = trips.ordered_points(points(spark, sf)).where(_EVERY_100TH)
    asked = p.select(F.col("src_id").alias("query_id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("base_date_time").alias("ts"))
    return _nearest(spark, sf, asked)


# boxes from a thousandth of a degree and a minute to several degrees and hours, around the same reports
_MIXED_SQL = f"""qb AS (SELECT src_id AS box_id, t - h AS t1, t + h AS t2, lon - d AS x1, lon + d AS x2, lat - d AS y1, lat + d AS y2
  FROM (SELECT *, 0.001::DOUBLE * (1 << CAST(src_id // 100 % 12 AS INT)) AS d, 60 * (1 << CAST(src_id // 100 % 9 AS INT)) AS h FROM op WHERE {_EVERY_100TH}))"""


@check(
    "range_join",
    f"""{with_points(_SUM, _MIXED_SQL)} SELECT {I('box_id')} AS box_id, count(DISTINCT s.mmsi) AS n, {I('sum(DISTINCT s.mmsi)')} AS vessels FROM qb b JOIN sm s
  ON s.x1 <= b.x2 AND s.x2 >= b.x1 AND s.y1 <= b.y2 AND s.y2 >= b.y1 AND s.t1 <= b.t2 AND s.t2 >= b.t1 GROUP BY box_id""",
)
def _(spark, sf):
    """Boxes of very different sizes around every report whose number is divisible by 100."""
    p = trips.ordered_points(points(spark, sf)).where(_EVERY_100TH)
    nth = F.expr("src_id div 100")
    d = F.lit(0.001) * F.pow(F.lit(2.0), nth % 12)
    h = F.make_dt_interval(secs=(60 * F.pow(F.lit(2.0), nth % 9)).cast("decimal(18,6)"))
    sides = [(F.col(c) + s * d).alias(n) for c, s, n in (("longitude", -1, "xmin"), ("longitude", 1, "xmax"), ("latitude", -1, "ymin"), ("latitude", 1, "ymax"))]
    at = F.col("base_date_time")
    boxes = p.select(F.col("src_id").alias("box_id"), F.struct(*sides, (at - h).alias("tmin"), (at + h).alias("tmax")).alias("box"))
    hits = retrieval.range_query(_summaries(spark, sf), boxes)
    return hits.groupBy("box_id").agg(F.count("*").alias("n"), F.sum("mmsi").alias("vessels"))


@check(
    "vessel_details",
    f"""{with_points(_SUM, _QBOX)} SELECT mmsi, nk AS trip_key, {I('t1')} AS t1, {I('t2')} AS t2, x1 AS xmin, x2 AS xmax FROM sm WHERE mmsi IN (
    SELECT s.mmsi FROM qb b JOIN sm s ON s.x1 <= b.x2 AND s.x2 >= b.x1 AND s.y1 <= b.y2 AND s.y2 >= b.y1 AND s.t1 <= b.t2 AND s.t2 >= b.t1)""",
)
def _(spark, sf):
    s = _summaries(spark, sf)
    d = retrieval.vessel_details(s, retrieval.range_query(s, _query_boxes(spark, sf)))
    return d.select("mmsi", "trip_key", sec("start_time").alias("t1"), sec("end_time").alias("t2"), "mbb.xmin", "mbb.xmax")


@check(
    "mbb_algebra",
    f"""{with_points(_SUM)} SELECT mmsi, nk AS trip_key, {Q('(x2 - x1) * (y2 - y1) * (t2 - t1)', 4)} AS volume,
    x1 >= 121.0 AND x2 <= 122.0 AND y1 >= 30.0 AND y2 <= 31.0 AND t1 >= 1735689600 AND t2 <= {T1} + 7200 AS inside,
    x1 <= 122.0 AND x2 >= 121.0 AND y1 <= 31.0 AND y2 >= 30.0 AND t1 <= {T1} + 7200 AND t2 >= 1735689600 AS meets FROM sm""",
)
def _(spark, sf):
    day = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    box = retrieval.box_column((121.0, 122.0, 30.0, 31.0, day, END + dt.timedelta(hours=2)))
    return _summaries(spark, sf).select(
        "mmsi", "trip_key", q(mbb_volume("mbb"), 4).alias("volume"), mbb_contains(box, "mbb").alias("inside"), mbb_intersects(box, "mbb").alias("meets")
    )


def _split_sql(n: int) -> str:
    """Round ``n`` of the parts: every part is cut at the median of its widest axis, the fullest is numbered first."""
    stats = ", ".join(f"min({a}) AS {a}0, quantile_disc({a}, 0.5) AS {a}m, max({a}) AS {a}1" for a in "xyt")
    widest = "CASE WHEN x1 - x0 >= y1 - y0 AND x1 - x0 >= t1 - t0 THEN 'x' WHEN y1 - y0 >= t1 - t0 THEN 'y' ELSE 't' END"
    pick = lambda end: f"CASE axis WHEN 'x' THEN x{end} WHEN 'y' THEN y{end} ELSE t{end} END"
    return f"""
    s{n} AS (SELECT part, count(*) AS n, {stats} FROM r{n - 1} GROUP BY part),
    w{n} AS (SELECT *, {pick('0')} AS lo, {pick('m')} AS mid, {pick('1')} AS hi FROM (SELECT *, {widest} AS axis FROM s{n})),
    c{n} AS (SELECT *, (SELECT max(part) FROM s{n}) + row_number() OVER (ORDER BY n DESC, part) AS made FROM w{n} WHERE lo < hi),
    r{n} AS (SELECT mmsi, nk, tmin, x, y, t, CASE WHEN v > mid OR (mid = hi AND v = hi) THEN made ELSE p0 END AS part
      FROM (SELECT r.mmsi, r.nk, r.tmin, r.x, r.y, r.t, r.part AS p0, c.mid, c.hi, c.made, CASE c.axis WHEN 'x' THEN r.x WHEN 'y' THEN r.y ELSE r.t END AS v
        FROM r{n - 1} r LEFT JOIN c{n} c USING (part)))"""


_PARTS = """r0 AS (SELECT mmsi, nk, t1 AS tmin, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (t1 + t2) / 7200 AS t, 0 AS part FROM sm)"""


@check(
    "st_partition",
    f"""{with_points(_SUM, _PARTS, _split_sql(1), _split_sql(2), _split_sql(3))}
    SELECT mmsi, nk AS trip_key, {I('tmin')} AS t1, {I('part')} AS part FROM r3""",
)
def _(spark, sf):
    s = retrieval.st_partition(_summaries(spark, sf), 8)
    return s.select("mmsi", "trip_key", sec("start_time").alias("t1"), F.col("part").cast("long").alias("part"))
