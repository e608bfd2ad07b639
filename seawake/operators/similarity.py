"""Shape codes and similar-track search (M7, M8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


# The shape code's value range per feature, buffer radius, bits per feature.
SHAPE_RANGES = {
    "convexity": (0.10, 1.00),
    "fractality": (1.30, 3.00),
    "nperimeter": (0.08, 0.25),
    "nproximity": (0.17, 0.32),
}
BUFFER = 0.01
BITS = 8
CODE_BITS = 32
GEOHASH_BITS = 40


def geohash_int(lat: Column, lon: Column) -> Column:
    """The 40 bits of an eight-character geohash as an integer: longitude bit first, interleaved."""
    half = GEOHASH_BITS // 2
    cells = float(1 << half)
    x = F.least(F.floor((lon + 180.0) / 360.0 * cells), F.lit((1 << half) - 1))
    y = F.least(F.floor((lat + 90.0) / 180.0 * cells), F.lit((1 << half) - 1))

    def spread(v: Column) -> Column:
        """A zero bit between any two bits of a 20-bit number."""
        for shift, mask in (
            (16, 0x0000FFFF0000FFFF),
            (8, 0x00FF00FF00FF00FF),
            (4, 0x0F0F0F0F0F0F0F0F),
            (2, 0x3333333333333333),
            (1, 0x5555555555555555),
        ):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(x), 1).bitwiseOR(spread(y))


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) >= 2:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (q[1] - ay) - (by - ay) * (q[0] - ax) > 0:
                    break
                out.pop()
            out.append(q)
        return out

    seq = p.tolist()  # plain floats: numpy's single numbers are several times slower here
    return np.array(half(seq)[:-1] + half(seq[::-1])[:-1])


def shape_features(x: np.ndarray, y: np.ndarray, r: float = BUFFER) -> dict[str, float]:
    """Features of the polyline grown by ``r``, in closed form.

    Area 2rL + pi r^2 and outline 2L + 2 pi r ignore overlap of the grown line with itself.
    The hull of a grown line is the grown hull, which is exact.
    """
    seg = np.hypot(np.diff(x), np.diff(y))
    length = float(seg.sum())
    area = max(2 * r * length + np.pi * r * r, 1e-6)
    outline = max(2 * length + 2 * np.pi * r, 1e-6)
    hull = _hull(np.column_stack([x, y]))
    nx, ny = np.roll(hull[:, 0], -1), np.roll(hull[:, 1], -1)
    hull_area = abs(float(np.sum(hull[:, 0] * ny - nx * hull[:, 1]))) / 2
    hull_len = float(np.hypot(nx - hull[:, 0], ny - hull[:, 1]).sum())
    grown_hull = hull_area + r * hull_len + np.pi * r * r
    if length > 0:
        cx = float(np.sum(seg * (x[1:] + x[:-1]) / 2) / length)
        cy = float(np.sum(seg * (y[1:] + y[:-1]) / 2) / length)
    else:
        cx, cy = float(x[0]), float(y[0])
    mean_dist = float(np.hypot(x - cx, y - cy).mean())
    return {
        "convexity": min(area / grown_hull, 1.0),
        "fractality": 1 - np.log(area) / (2 * np.log(outline)) if outline != 1 else np.inf,
        "nperimeter": 2 * np.sqrt(np.pi * area) / outline,
        "nproximity": (2 / 3) * np.sqrt(area / np.pi) / (mean_dist + 1e-6),
    }


def midpoints(low: float, high: float, bits: int = BITS) -> np.ndarray:
    """The inner borders of ``2 ** bits`` cells made by halving a range again and again."""
    edges = np.array([low, high])
    for _ in range(bits):
        halved = np.empty(2 * len(edges) - 1)
        halved[::2], halved[1::2] = edges, (edges[:-1] + edges[1:]) / 2
        edges = halved
    return edges[1:-1]


_BORDERS = {name: midpoints(*bounds) for name, bounds in SHAPE_RANGES.items()}


def quantise(value: float, borders: np.ndarray) -> int:
    """Cell of a value: the number of borders below it, so a border itself counts as lower."""
    return int(np.searchsorted(borders, value, side="left"))


def interleave(codes: list[int], bits: int = BITS) -> int:
    """First bits of all codes, then second bits, and so on; the most significant bit first."""
    out = 0
    for b in range(bits - 1, -1, -1):
        for c in codes:
            out = (out << 1) | ((c >> b) & 1)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return (v - v.min()) / (v.max() - v.min() + 1e-9)


def encode_shape(gh: np.ndarray, sec: np.ndarray) -> int:
    if len(gh) < 3:
        return 0
    f = shape_features(_unit(gh.astype("float64")), _unit(sec.astype("float64")))
    return interleave([quantise(f[name], borders) for name, borders in _BORDERS.items()])


@F.pandas_udf(T.LongType())
def _encode(gh: pd.Series, sec: pd.Series) -> pd.Series:
    return pd.Series([encode_shape(np.asarray(g), np.asarray(s)) for g, s in zip(gh, sec)], dtype="int64")


def shape_code(samples: DataFrame) -> DataFrame:
    """M7: add the 32-bit ``code`` of each sample's ``obs`` and ``obs_time``.

    Geohash integers are native; the geometry of the fixed 120 points runs in Arrow batches.
    """
    gh = F.transform("obs", lambda p: geohash_int(p["lat"].cast("double"), p["lon"].cast("double")))
    return samples.withColumn("code", _encode(gh, F.col("obs_time")))


def similar_tracks(
    samples: DataFrame, queries: DataFrame, k: int = 5, exclude_self: bool = False, id_col: str = "global_traj_id"
) -> DataFrame:
    """M8: per query the ``k`` samples with the smallest ``code XOR query code``, ties by id.

    ``samples`` has the id and ``code``; ``queries`` has ``query_id``, ``code`` and, to leave a track
    out of its own answer, ids from the same space.  Codes form a trie of one byte per level, whose
    nodes hold the number of samples below each child.  Among the children of a node those with
    the smaller ``byte XOR query byte`` hold the smaller distances, so a query takes children in that
    order until one holds more samples than are still wanted, and goes down into that one only: four look-ups,
    after which at most k + 1 codes are left, which are joined on equality.  Of one code at most k + 1
    samples, those with the smallest ids, can be in any answer, so repeated codes are cut to that first.
    """
    need = k + 1 if exclude_self else k
    asked = queries.select("query_id", F.col("code").alias("q"))
    s = samples.select(F.col(id_col).alias("_id"), F.col("code").alias("_code"))
    s = s.withColumn("_rn", F.row_number().over(W.partitionBy("_code").orderBy("_id"))).where(F.col("_rn") <= need).drop("_rn")
    found = _nearest_codes(s.groupBy("_code").agg(F.count("*").alias("n")), asked.select("q").distinct(), need)
    cand = asked.join(found, "q").join(s, "_code")
    if exclude_self:
        cand = cand.where(F.col("query_id") != F.col("_id"))
    cand = cand.withColumn("xor", F.col("q").bitwiseXOR(F.col("_code")))
    r = W.partitionBy("query_id").orderBy("xor", "_id")
    return cand.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("_id").alias(id_col), "xor"
    )


#: a child that is taken whole wants more samples than there can be
_ALL = 1 << 62


def _nearest_codes(codes: DataFrame, asked: DataFrame, need: int) -> DataFrame:
    """``q, _code``: the codes nearest to each ``q`` that hold ``need`` samples together (``codes``: ``_code, n``)."""
    level, nodes = codes.select(F.col("_code").alias("key"), "n"), []
    for _ in range(CODE_BITS // BITS):
        child = F.struct(F.col("key").bitwiseAND((1 << BITS) - 1).alias("b"), "n")
        level = level.groupBy(F.shiftright("key", BITS).alias("key")).agg(F.sum("n").alias("n"), F.collect_list(child).alias("kids"))
        nodes.append(level.select("key", "kids"))
        level = level.select("key", "n")
    at = asked.select("q", F.lit(0).cast("long").alias("key"), F.lit(need).cast("long").alias("want"))
    for depth, node in enumerate(reversed(nodes)):
        if depth < 2:  # one node, then at most 256
            node = F.broadcast(node)
        byte = F.shiftright("q", CODE_BITS - BITS * (depth + 1)).bitwiseAND((1 << BITS) - 1)
        kids = F.array_sort(F.transform("kids", lambda c: F.struct(c["b"].bitwiseXOR(F.col("byte")).alias("x"), c["b"].alias("b"), c["n"].alias("n"))))
        at = at.join(node, "key").withColumn("byte", byte)
        at = at.select("q", "key", F.explode(_taken(kids, F.col("want"))).alias("t"))
        at = at.select("q", F.shiftleft("key", BITS).bitwiseOR(F.col("t.b")).alias("key"), F.col("t.want").alias("want"))
    return at.select("q", F.col("key").alias("_code"))


def _taken(kids: Column, want: Column) -> Column:
    """The children to go into, in order, until ``want`` samples are found, and what is wanted of each."""
    start = F.struct(
        want.cast("long").alias("left"), F.array().cast("array<struct<b:bigint,want:bigint>>").alias("out")
    )

    def step(a: Column, c: Column) -> Column:
        whole = F.when(c["n"] <= a["left"], F.lit(_ALL)).otherwise(a["left"])
        grown = F.concat(a["out"], F.array(F.struct(c["b"].cast("long").alias("b"), whole.alias("want"))))
        return F.when(a["left"] > 0, F.struct((a["left"] - c["n"]).alias("left"), grown.alias("out"))).otherwise(a)

    return F.aggregate(kids, start, step, lambda a: a["out"])
