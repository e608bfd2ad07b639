"""Splitting long tracks by hulls (for T12, T13).

The report farthest from a chord is a corner of the convex hull of the reports in question.  One task descends through the
splits of a long stretch, however deep they lie, down to pieces that other tasks finish.  It asks the hulls of groups of
reports, not the reports, and so does not read the stretch again at each split.

A stretch too long for a task to hold is first cut into *leaves* of some tens of reports, and only the corners of their
hulls go to the task.  A cut may fall inside a leaf.  What is left of that leaf has other corners
(unless all its reports are), but none of its reports is farther off than the whole leaf's farthest corner; as long as the
farthest known report is at least that far, it is the farthest of all.  Where it is not, the piece is left
open for the next round, which cuts its leaves anew at the cuts known by then, or holds all its reports.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: reports of a leaf
LEAF_ROWS = 32
#: corners of a group, about; it has a hull of its own
GROUP_ROWS = 4096
#: reports nearer than this to an edge (times its length, square degrees) stay corners, so equal distances are seen
_FLAT = 1e-12

_CORNERS = "mmsi long, stretch long, cap double, leaf long, n long, ts timestamp, lon double, lat double"
_PIECES = "mmsi long, stretch long, kind string, level double, a timestamp, b timestamp, lon double, lat double"


def hull_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull and of what lies on its edges, ascending; of equal points the first."""
    order = np.lexsort((np.arange(len(x)), y, x))
    sx, sy = x[order], y[order]
    new = np.r_[True, (np.diff(sx) != 0) | (np.diff(sy) != 0)]
    order = order[new]
    px, py = sx[new].tolist(), sy[new].tolist()

    def half(seq) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) >= 2:
                a, b = out[-2], out[-1]
                if (px[b] - px[a]) * (py[i] - py[a]) - (py[b] - py[a]) * (px[i] - px[a]) >= -_FLAT:
                    break
                out.pop()
            out.append(i)
        return out

    corners = set(half(range(len(px)))) | set(half(range(len(px) - 1, -1, -1)))
    return np.sort(order[list(corners)])


def distances(x, y, ax, ay, bx, by) -> np.ndarray:
    """Distances in degrees from the line through two reports, or from the report if both lie in one place."""
    dx, dy = bx - ax, by - ay
    if dx == 0 and dy == 0:
        return np.hypot(x - ax, y - ay)
    return np.abs(dy * x - dx * y + bx * ay - by * ax) / np.hypot(dx, dy)


def _corners(leaf_rows: int):
    """Corners of the leaves of one day of a stretch, with the ends of each leaf."""

    def run(day: pa.Table) -> pa.Table:
        day = day.sort_by("ts")
        x, y = day["lon"].to_numpy(), day["lat"].to_numpy()
        ts = day["ts"].cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy()
        keep, leaf, n = [], [], []
        for at in range(0, len(x), leaf_rows):
            end = min(at + leaf_rows, len(x))
            places = np.union1d(hull_places(x[at:end], y[at:end]), [0, end - at - 1]) + at
            keep.append(places)
            leaf.append(np.full(len(places), ts[at]))
            n.append(np.full(len(places), end - at))
        out = day.take(np.concatenate(keep))
        out = out.append_column("leaf", pa.array(np.concatenate(leaf))).append_column("n", pa.array(np.concatenate(n)))
        return out.select(["mmsi", "stretch", "cap", "leaf", "n", "ts", "lon", "lat"])

    return run


class _Stretch:
    """The corners of a stretch in order of time, and the hulls of groups of leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaf: np.ndarray, n: np.ndarray):
        self.x, self.y = x, y
        first = np.r_[True, leaf[1:] != leaf[:-1]]
        #: the leaf of each corner, and first corner (and one more border) and rows before each leaf
        self.of = np.cumsum(first) - 1
        self.border = np.r_[np.flatnonzero(first), len(x)]
        self.before = np.r_[0, np.cumsum(n[first])]
        #: leaves all of whose reports are corners, so that nothing of them is unknown
        self.whole = np.diff(self.border) == n[first]
        #: leaves of a group
        self.leaves = max(1, GROUP_ROWS * (len(self.border) - 1) // len(x))
        hulls = []
        for a in range(0, len(self.border) - 1, self.leaves):
            u, v = self.border[a], self.border[min(a + self.leaves, len(self.border) - 1)]
            hulls.append(hull_places(x[u:v], y[u:v]) + u)
        self.hull = np.concatenate(hulls)
        self.hull_border = np.r_[0, np.cumsum([len(h) for h in hulls])]

    def rows(self, a: int, b: int) -> int:
        """Reports in the leaves from corner ``a`` to ``b``: at least those between the two."""
        return int(self.before[self.of[b] + 1] - self.before[self.of[a]])

    def _between(self, a: int, b: int) -> np.ndarray:
        """Corners strictly between two, of whole groups only those of the group's hull."""
        first, last = -(-(self.of[a] + 1) // self.leaves), self.of[b] // self.leaves
        if last <= first:
            return np.arange(a + 1, b)
        u, v = self.border[first * self.leaves], self.border[last * self.leaves]
        whole = self.hull[self.hull_border[first] : self.hull_border[last]]
        return np.r_[np.arange(a + 1, u), whole, np.arange(v, b)]

    def farthest(self, a: int, b: int) -> tuple[int, float, float]:
        """The farthest known corner between two, its distance, and a bound of what is not known."""
        ends = self.x[a], self.y[a], self.x[b], self.y[b]
        at = self._between(a, b)
        place, known = -1, -1.0
        if len(at):
            d = distances(self.x[at], self.y[at], *ends)
            k = int(np.argmax(d))
            place, known = int(at[k]), float(d[k])
        unknown = -1.0
        for leaf, cut in ((self.of[a], a != self.border[self.of[a]]), (self.of[b], b != self.border[self.of[b] + 1] - 1)):
            if cut and not self.whole[leaf]:
                part = slice(self.border[leaf], self.border[leaf + 1])
                unknown = max(unknown, float(distances(self.x[part], self.y[part], *ends).max()))
        return place, known, unknown


def _descend(floor_deg: float, stretch_rows: int):
    """Cuts of one stretch down to pieces of about ``stretch_rows`` reports, and the pieces that may have more cuts."""

    def run(corners: pa.Table) -> pa.Table:
        corners = corners.sort_by("ts")
        s = _Stretch(*(corners[c].to_numpy() for c in ("lon", "lat", "leaf", "n")))
        out: dict[str, list] = {k: [] for k in ("kind", "level", "a", "b")}

        def give(kind, level, a, b):
            for key, value in zip(out, (kind, level, a, b)):
                out[key].append(value)

        todo = [(0, len(s.x) - 1, corners["cap"][0].as_py())]
        while todo:
            a, b, cap = todo.pop()
            if a == b:
                continue
            if s.rows(a, b) <= stretch_rows:
                give("small", cap, a, b)
                continue
            place, known, unknown = s.farthest(a, b)
            if max(known, unknown) <= floor_deg:
                continue
            if known < unknown:
                give("open", cap, a, b)
                continue
            cap = min(cap, known)
            give("cut", cap, place, place)
            todo += [(a, place, cap), (place, b, cap)]
        a, b = (pa.array(out[k], pa.int64()) for k in ("a", "b"))
        ids = corners.slice(0, 1).select(["mmsi", "stretch"]).take(pa.array(np.zeros(len(a), np.int64)))
        for name, column in (
            ("kind", pa.array(out["kind"], pa.string())),
            ("level", pa.array(out["level"], pa.float64())),
            ("a", corners["ts"].take(a)),
            ("b", corners["ts"].take(b)),
            ("lon", corners["lon"].take(a)),
            ("lat", corners["lat"].take(a)),
        ):
            ids = ids.append_column(name, column)
        return ids

    return run


def hull_corners(rows: DataFrame, leaf_rows: int) -> DataFrame:
    """Corners of the leaves of all stretches; a task sees a day of one stretch at a time."""
    day = F.unix_date(F.to_date("ts"))
    return rows.withColumn("day", day).groupBy("mmsi", "stretch", "day").applyInArrow(_corners(leaf_rows), _CORNERS)


def every_report(rows: DataFrame) -> DataFrame:
    """All reports of stretches that fit a task, each a leaf of its own."""
    return rows.select("mmsi", "stretch", "cap", F.unix_micros("ts").alias("leaf"), F.lit(1).cast("long").alias("n"), "ts", "lon", "lat")


def cuts_and_pieces(corners: DataFrame, floor_deg: float, stretch_rows: int) -> DataFrame:
    """Per stretch its cuts, and the pieces still to be simplified: small ones, and those left open."""
    return corners.groupBy("mmsi", "stretch").applyInArrow(_descend(floor_deg, stretch_rows), _PIECES)


def rows_of_pieces(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Reports of the pieces as ``mmsi, ts, lon, lat, stretch, cap, kind``; met on vessel, stretch and day."""
    days = F.sequence(F.unix_date(F.to_date("a")), F.unix_date(F.to_date("b")))
    p = pieces.select("mmsi", "stretch", "kind", "level", "a", "b", F.explode(days).alias("day"))
    r = rows.drop("cap").withColumn("day", F.unix_date(F.to_date("ts")))
    met = r.join(p, ["mmsi", "stretch", "day"]).where(F.col("ts").between(F.col("a"), F.col("b")))
    return met.select("mmsi", "ts", "lon", "lat", F.unix_micros("a").alias("stretch"), F.col("level").alias("cap"), "kind")
