"""Boxes of trips against query boxes and points, in one task of a part (``plans.blocks``): range and nearest-neighbour search.

A part holds all trips of its vessels.  Their boxes are packed into a tree of sixteen to a node by longitude, latitude and time, which a run of
queries goes down together; a run is short enough for one number per query and vessel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seawake.operators.meetings import _spread, runs
from seawake.plans.blocks import FIRST

#: queries times trips, or vessels, of a run
RUN = 8_000_000
#: rows of a batch that leaves
ROWS = 250_000
FAN = 16
SIDES = ["x0", "x1", "y0", "y1", "t0", "t1"]
HOUR_US = 3_600_000_000.0


class BoxTree:
    """Boxes, columns ``SIDES``, packed by sort-tile-recursive order."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        slabs = max(1, round((n / FAN) ** (1 / 3)))
        x, y, t = ((boxes[:, k] + boxes[:, k + 1]) / 2 for k in (0, 2, 4))
        at, rank = np.zeros(n, np.int64), np.arange(n)
        at[np.argsort(x)] = rank * slabs // max(n, 1)
        at[np.lexsort((y, at))] = rank * slabs * slabs // max(n, 1)
        self.order = np.lexsort((t, at))
        self.levels = [boxes[self.order].T.copy()]
        while self.levels[-1].shape[1] > FAN:
            low = self.levels[-1]
            heads = np.arange(0, low.shape[1], FAN)
            self.levels.append(np.stack([(np.maximum if k % 2 else np.minimum).reduceat(low[k], heads) for k in range(6)]))

    def meeting(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, box) that share a point."""
        top = self.levels[-1].shape[1]
        q, node = np.repeat(np.arange(len(asked)), top), np.tile(np.arange(top), len(asked))
        for level in range(len(self.levels) - 1, -1, -1):
            box = self.levels[level]
            for k in (4, 0, 2):
                near = (box[k][node] <= asked[q, k + 1]) & (box[k + 1][node] >= asked[q, k])
                q, node = q[near], node[near]
            if level:
                below = np.minimum(FAN, self.levels[level - 1].shape[1] - node * FAN)
                q, node = np.repeat(q, below), _spread(node * FAN, below)
        return q, self.order[node]


class Part:
    """The trips of a part by vessel, and the queries by number."""

    def __init__(self, batches: Iterator[pa.RecordBatch], number: str):
        table = pa.Table.from_batches(list(batches))
        first = table.column("side").to_numpy() == FIRST
        trips, asked = table.filter(pa.array(first)), table.filter(pa.array(~first))
        sides = lambda t: np.stack([t.column(c).to_numpy().astype(float) for c in SIDES], 1)
        mmsi = trips.column("mmsi").to_numpy() if len(trips) else np.zeros(0, np.int64)
        order = np.argsort(mmsi, kind="stable")
        self.boxes = sides(trips)[order]
        self.vessels, self.v, self.count = np.unique(mmsi[order], return_inverse=True, return_counts=True)
        self.start = np.cumsum(self.count) - self.count
        ids = table.column(number).filter(pa.array(~first)).combine_chunks().dictionary_encode()
        code = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.ids, self.code, self.asked = ids.dictionary, code[order], sides(asked)[order]
        self.empty = not len(self.vessels) or not len(self.code)


def hits(number: str):
    """Each vessel with a trip that meets a query box, once per query number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Part(batches, number)
        if p.empty:
            return
        tree, vessels = BoxTree(p.boxes), len(p.vessels)
        each = np.bincount(p.code, minlength=len(p.ids))
        ends = np.cumsum(each)
        for a, b in runs(each * len(p.boxes), RUN):
            lo, hi = ends[a] - each[a], ends[b - 1]
            q, trip = tree.meeting(p.asked[lo:hi])
            met = np.zeros((b - a) * vessels, bool)
            met[(p.code[lo:hi][q] - a) * vessels + p.v[trip]] = True
            met = np.flatnonzero(met)
            for k in range(0, len(met), ROWS):
                c, v = np.divmod(met[k : k + ROWS], vessels)
                yield pa.RecordBatch.from_arrays([p.ids.take(pa.array(c + a)), pa.array(p.vessels[v])], names=[number, "mmsi"])

    return of


def nearest(k: int, radius: float, widest: int):
    """Of a part's vessels those that can be among the ``k`` nearest of all, with the least doubling of the ring that meets them.

    The ring of a query widens until it holds ``k`` of these vessels: that of all vessels is not wider.  All vessels of
    narrower rings are given, fewer than ``k``, and of the last ring the ``k`` nearest, the smallest MMSI first.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Part(batches, "query_id")
        if p.empty:
            return
        tree, vessels, none = BoxTree(p.boxes), len(p.vessels), widest + 1
        rings = np.array([radius * 2**n for n in range(none)])

        def apart(points, trip):
            b = p.boxes[trip].T
            x, y, t = (points[:, c] for c in (0, 2, 4))
            dx, dy = np.maximum(np.maximum(b[0] - x, x - b[1]), 0), np.maximum(np.maximum(b[2] - y, y - b[3]), 0)
            gap = np.maximum(np.maximum(b[4] - t, t - b[5]), 0)
            hours = gap / 1e6 / 3600
            return gap <= HOUR_US, np.maximum(dx, dy), np.sqrt(dx * dx + dy * dy + hours * hours)

        def found(points, top):
            """Least doubling and distance per query and vessel, of the ring of ``top`` doublings."""
            wide = rings[top] * (1 + 1e-9) + 1e-9
            q, trip = tree.meeting(points + np.array([-wide, wide, -wide, wide, -HOUR_US, HOUR_US]))
            timely, reach, d = apart(points[q], trip)
            level = np.searchsorted(rings[: top + 1], reach)
            inside = timely & (level <= top)
            at, level, d = (q * vessels + p.v[trip])[inside], level[inside], d[inside]
            least, distance = np.full(len(points) * vessels, none, np.int8), np.full(len(points) * vessels, np.inf)
            np.minimum.at(least, at, level.astype(np.int8))
            np.minimum.at(distance, at, d)
            # a vessel's nearest trip in space and time may lie outside the ring that another of its trips meets
            far = np.flatnonzero((least < none) & (distance > rings[top]))
            far = far[p.count[far % vessels] > 1]
            for a, b in runs(p.count[far % vessels], RUN):
                at = far[a:b]
                n = p.count[at % vessels]
                timely, _, d = apart(points[np.repeat(at // vessels, n)], _spread(p.start[at % vessels], n))
                np.minimum.at(distance, np.repeat(at, n)[timely], d[timely])
            return least.reshape(-1, vessels), distance.reshape(-1, vessels)

        for lo, hi in runs(np.full(len(p.code), len(p.boxes)), RUN):
            left = np.arange(lo, hi)
            for top in sorted({min(t, widest) for t in (0, 1, 2, 4, 7, widest)}):
                least, distance = found(p.asked[left], top)
                upto = np.cumsum([(least == n).sum(1) for n in range(top + 1)], 0)
                full = upto[-1] >= k
                done = full | (top == widest)
                if done.any():
                    least, distance = least[done], distance[done]
                    stop = np.where(full[done], (upto[:, done] < k).sum(0), widest)[:, None]
                    last = np.where(least == stop, distance, np.inf)
                    bound = np.partition(last, k - 1, 1)[:, k - 1 : k] if vessels > k else np.full((len(last), 1), np.inf)
                    ties = (last == bound) & (last < np.inf)
                    room = k - (last < bound).sum(1, keepdims=True)
                    keep = (least < stop) | (last < bound) | (ties & (np.cumsum(ties, 1) <= room))
                    q, v = np.nonzero(keep)
                    columns = [p.ids.take(pa.array(p.code[left[done][q]])), p.vessels[v], least[q, v].astype(np.int32), distance[q, v]]
                    yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], names=["query_id", "mmsi", "level", "distance"])
                left = left[~done]
                if not len(left):
                    break

    return of
