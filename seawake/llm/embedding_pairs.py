"""Near-duplicate vectors by an epsilon grid order join.

*Order.*  Vectors are scaled to length one, where a cosine of ``c`` is a distance of ``sqrt(2 - 2c)``.  Equal
vectors collapse to one, with their number.  The leading principal directions (from second moments over all
vectors) give each vector a cell of a grid of that width, and the vectors are sorted by cell, first
direction first: epsilon grid order.  The order is cut into intervals of bounded bytes, each with the box its
vectors lie in.  Beside the leading directions a box has the length of the rest of the vector: distances in both
together never exceed the true ones, so boxes further apart than the width hold no pair.

*Join.*  Intervals are grouped by ``FANOUT`` to larger ones up to a single one.  The join starts with that one and itself
and goes down: a pair of intervals is replaced by the pairs of their children that are not provably
distant, level by level, as Spark joins.  The pairs of the lowest level meet in one task each, which goes on
halving them as long as boxes exclude halves, and multiplies what is left.  Products are made in single
precision; those within its error of the limit are decided in double precision.

A pair of intervals gives back the numbers of links of its vectors and a forest of links, never the links
themselves, so a group of many copies costs products, not rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import stored
from seawake.llm.components import connected

#: leading directions that order the vectors, and that their boxes are made of
ORDERED, BOXED = 8, 16
#: bytes of vectors of an interval of the lowest level; a pair of them is what a task holds
INTERVAL_BYTES = 1 << 20
#: intervals that form one of the next level
FANOUT = 16
#: rows of an interval that are no longer halved
LEAST_ROWS = 256
#: rows that are turned to numpy at once
SLICE_ROWS = 4096


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """The vectors at length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # squares of what is left neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


def _usable(batch: pa.RecordBatch, kind: str) -> dict[int, tuple[list[int], list[bytes]]]:
    """Of each vector length the places and the bytes of the vectors that can link."""
    out: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, (key, v) in enumerate(zip(batch.column(0), batch.column(1))):
        if key.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False)
            if np.isfinite(x).all() and x.any():
                at, raw = out.setdefault(len(x), ([], []))
                at.append(i)
                raw.append(x.astype(kind).tobytes())
    return out


def _parts(batches, kind: str):
    """A bounded number of rows at a time, with their usable vectors by length."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield part, _usable(part, kind)


def places_of(units: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Coordinates in the leading directions, and the length of the rest."""
    p = units @ turn
    return np.c_[p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))]


def principal_directions(vectors: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Of each vector length the directions, strongest first, as columns; at most ``BOXED``.

    Every vector counts.  What comes to the driver is one matrix per task and length, added up by Spark first.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for _, usable in _parts(batches, kind):
            for d, (_, raw) in usable.items():
                x = units_of(raw, kind)
                sums[d] = sums.get(d, 0) + x.T @ x
        rows = [(d, i, m[i].tolist()) for d, m in sums.items() for i in range(d)]
        for at in range(0, len(rows), 256):
            d, i, x = zip(*rows[at : at + 256])
            arrays = [pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["d", "i", "x"])

    parts = vectors.mapInArrow(run, "d int, i int, x array<double>")
    cells = parts.select("d", "i", F.posexplode("x").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("d", "i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))
    found: dict[int, list] = {}
    for r in rows.select("d", "i", F.col("row.v").alias("x")).collect():
        found.setdefault(r["d"], []).append((r["i"], r["x"]))
    out = {}
    for d, lines in found.items():
        _, turn = np.linalg.eigh(np.array([x for _, x in sorted(lines)]))
        out[d] = np.ascontiguousarray(turn[:, ::-1][:, :BOXED])
    return out


def _places(turns, width: float, kind: str):
    """Per row its grid order key, fingerprint and bytes, NULL if it cannot link."""

    def run(batches):
        for part, usable in _parts(batches, kind):
            keys, prints, body = ([None] * part.num_rows for _ in range(3))
            for d, (at, raw) in usable.items():
                cells = np.floor(units_of(raw, kind) @ turns.value[d][:, :ORDERED] / width) + (1 << 15)
                for i, x, c in zip(at, raw, cells.astype(">u2")):
                    keys[i], prints[i], body[i] = d.to_bytes(4, "big") + c.tobytes(), xxhash.xxh3_128_digest(x), x
            arrays = [part.column(0), *(pa.array(x, pa.binary()) for x in (keys, prints, body))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cell", "print", "raw"])

    return run


_INTERVAL = "part int, n int, d int, gids array<long>, reps array<long>, times array<long>, raw binary, lo array<double>, hi array<double>"


def _pack(turns, kind: str, most: int):
    """Sorted vectors to intervals: one row each, numbered within the partition."""
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    types = (pa.int32(), pa.int32(), pa.int32(), longs, longs, longs, pa.binary(), doubles, doubles)

    def interval(part, n, held):
        gids, reps, times, raw = zip(*held)
        x = units_of(list(raw), kind)
        p = places_of(x, turns.value[x.shape[1]])
        row = (part, n, x.shape[1], gids, reps, times, b"".join(raw), p.min(0).tolist(), p.max(0).tolist())
        names = [c.split()[0] for c in _INTERVAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names=names)

    def run(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (len(held[0][3]) != len(row[3]) or size + len(row[3]) > most):
                    yield interval(part, n, held)
                    held, size, n = [], 0, n + 1
                held.append(row)
                size += len(row[3])
        if held:
            yield interval(part, n, held)

    return run


def _numbered(intervals: DataFrame) -> tuple[DataFrame, int]:
    """Intervals numbered in their order; only the number per partition passes through the driver."""
    counts = {r["part"]: r["c"] for r in intervals.groupBy("part").agg(F.count(F.lit(1)).alias("c")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    at = intervals.sparkSession.createDataFrame(offsets, "part int, before long")
    return intervals.join(F.broadcast(at), "part").withColumn("node", F.col("before") + F.col("n")).drop("part", "n", "before"), before


def _gap(p: str, q: str):
    """The least squared distance of two boxes; of boxes of different vector lengths none."""
    sides = F.zip_with(f"{p}lo", f"{q}hi", lambda a, b: F.greatest(F.lit(0.0), a - b))
    other = F.zip_with(f"{q}lo", f"{p}hi", lambda a, b: F.greatest(F.lit(0.0), a - b))
    total = F.aggregate(F.zip_with(sides, other, lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.col(f"{p}d") == F.col(f"{q}d"), total)


def _level(boxes: DataFrame) -> DataFrame:
    """The boxes of the next level: of ``FANOUT`` neighbours, one for each vector length among them."""
    sides = boxes.select(F.expr(f"node div {FANOUT}").alias("node"), "d", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "b"))
    sides = sides.groupBy("node", "d", "i").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    both = sides.groupBy("node", "d").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))
    return both.select("node", "d", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


def close_intervals(boxes: DataFrame, count: int, width: float) -> DataFrame:
    """Pairs ``a <= b`` of interval numbers whose boxes are no further apart than ``width``."""
    levels, n = [stored(boxes.select("node", "d", "lo", "hi"), "grid-boxes")], count
    while n > 1:
        levels.append(stored(_level(levels[-1]), "grid-boxes"))
        n = -(-n // FANOUT)
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in reversed(levels[:-1] if len(levels) > 1 else levels):
        up = F.expr(f"node div {FANOUT}") if len(levels) > 1 else F.lit(0).cast("long")
        side = {
            p: level.select(up.alias(p), F.col("node").alias(f"{p}node"), *(F.col(c).alias(f"{p}{c}") for c in ("d", "lo", "hi")))
            for p in ("a", "b")
        }
        pairs = pairs.join(side["a"], "a").join(side["b"], "b").where("anode <= bnode")
        pairs = pairs.where(_gap("a", "b") <= width * width * (1 + 1e-9) + 1e-9)
        pairs = stored(pairs.select(F.col("anode").alias("a"), F.col("bnode").alias("b")).distinct(), "grid-pairs")
    return pairs


class _Forest:
    """Labels of the rows of a pair of intervals; equal labels are joined by links found so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.label[i], self.label[j]
            new = x != y
            if not new.any():
                return
            i, j, x, y = i[new], j[new], x[new], y[new]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent != parent[parent]).any():
                parent = parent[parent]
            self.label = parent[self.label]


def join_intervals(x, y, px, py, tx, ty, limit: float, same: bool, least_rows: int = LEAST_ROWS):
    """Numbers of links of the rows of two intervals, and labels of both together.

    ``x`` and ``y`` are unit vectors, ``px`` and ``py`` their places in the box directions, ``tx`` and ``ty`` how many
    equal vectors a row stands for.  Recursively halves both; halves whose boxes are too distant are skipped.
    """
    wide = (2 - 2 * limit) * (1 + 1e-6) + 1e-9
    error = max(1e-6, 4 * x.shape[1] * float(np.finfo(np.float32).eps))
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = _Forest(len(x) if same else len(x) + len(y))
    shift = 0 if same else len(x)

    def leaf(a, b, c, d):
        s = fx[a:b] @ fy[c:d].T
        near = s >= limit - error
        if not near.any():
            return
        i, j = np.nonzero(near)
        doubt = s[i, j] < limit + error
        if doubt.any():
            exact = np.einsum("ij,ij->i", x[a + i[doubt]].astype(np.float64), y[c + j[doubt]].astype(np.float64))
            wrong = np.flatnonzero(doubt)[exact < limit]
            near[i[wrong], j[wrong]] = False
        if same and a == c:
            near = np.triu(near, 1)
        near_x, near_y = near @ ty[c:d], tx[a:b] @ near
        nx[a:b] += near_x
        if same:
            nx[c:d] += near_y
        else:
            ny[c:d] += near_y
        i, j = np.nonzero(near)
        forest.join(a + i, shift + c + j)

    def go(a, b, c, d):
        p, q = px[a:b], py[c:d]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > wide:
            return
        if b - a <= least_rows and d - c <= least_rows:
            return leaf(a, b, c, d)
        m, n = (a + b) // 2, (c + d) // 2
        if same and a == c:
            for part in ((a, m, a, m), (a, m, m, b), (m, b, m, b)):
                go(*part)
        elif b - a >= d - c:
            go(a, m, c, d), go(m, b, c, d)
        else:
            go(a, b, c, n), go(a, b, n, d)

    if len(x) and len(y):
        go(0, len(x), 0, len(y))
    return nx, ny, forest.label


def _compare(turns, kind: str, limit: float, least_rows: int):
    def run(table):
        rows = sorted(table.select(["node", "d", "gids", "reps", "times", "raw"]).to_pylist(), key=lambda r: r["node"])
        a, b, same = rows[0], rows[-1], len(rows) == 1
        x, y = (units_of([r["raw"][i : i + len(r["raw"]) // len(r["gids"])] for i in range(0, len(r["raw"]), len(r["raw"]) // len(r["gids"]))], kind) for r in (a, b))
        px, py = (places_of(v, turns.value[a["d"]]) for v in (x, y))
        tx, ty = (np.array(r["times"], np.int64) for r in (a, b))
        nx, ny, label = join_intervals(x, y, px, py, tx, ty, limit, same, least_rows)
        gids, reps = (np.array(a[c] if same else a[c] + b[c], np.int64) for c in ("gids", "reps"))
        links = nx if same else np.r_[nx, ny]
        keep = links > 0
        return pa.table({"gid": gids[keep], "links": links[keep], "a": reps[keep], "b": reps[label[keep]]})

    return run


def _with_copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with what was ``found`` of their vector; vectors with many copies come by broadcast.

    A vector is one of many copies if it makes up a thousandth of all rows, so there are a thousand at most.
    """
    total = found.agg(F.sum("times").alias("n")).first()["n"] or 0
    often = F.col("times") * 1000 > total
    hot = found.where(often).select(F.col("print").alias("hot"), F.col("links").alias("l"), F.col("comp").alias("c"))
    marked = rows.join(F.broadcast(hot), rows["print"] == F.col("hot"), "left")
    done = marked.where("hot is not null or print is null").select("vec_id", F.col("l").alias("links"), F.col("c").alias("comp"))
    rest = marked.where("hot is null and print is not null").select("vec_id", "print")
    return done.unionByName(rest.join(found.where(~often).select("print", "links", "comp"), "print").drop("print"))


def embedding_components(vectors: DataFrame, limit: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding)``.

    Two rows link if the cosine of their vectors, in double precision, is ``limit`` or more; ``n_links`` counts the other
    rows a row links with, ``component_id`` is the smallest ``vec_id`` reachable and ``kept`` says that it is the row's
    own.  A vector that is NULL, empty or zero, or holds NULL, NaN or an infinity links with nothing and is its own
    component; so does a row without ``vec_id``, whose ``component_id`` is NULL and which is kept.  Vectors of
    different lengths do not link.  Rows that share a ``vec_id`` are one node: what one of them links with all reach.
    Other columns are not read.  An empty table gives no rows.
    """
    if not 0 < limit <= 1:
        raise ValueError("the limit must be above 0 and at most 1")
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    body = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if element == "float" else "array<double>").alias("embedding"),
    )
    width = math.sqrt(2 - 2 * limit) or 1e-6
    turns = spark.sparkContext.broadcast(principal_directions(body, kind))
    placed = stored(body.mapInArrow(_places(turns, width, kind), "vec_id long, cell binary, print binary, raw binary"), "grid-places")
    usable = placed.where("print is not null")

    # equal vectors once; the node of a vector is the smallest id that has it
    once = usable.groupBy("print").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("cell").alias("cell"), F.first("raw").alias("raw"))
    once = stored(once.withColumn("gid", F.monotonically_increasing_id()), "grid-vectors")
    size = once.agg(F.sum(F.octet_length("raw")).alias("n")).first()["n"] or 0
    ordered = once.repartitionByRange(max(1, -(-size // (8 * INTERVAL_BYTES))), "cell", "print").sortWithinPartitions("cell", "print")
    intervals = stored(ordered.select("gid", "rep", "times", "raw").mapInArrow(_pack(turns, kind, INTERVAL_BYTES), _INTERVAL), "grid-intervals")
    intervals, count = _numbered(intervals)
    pairs = close_intervals(intervals, count, width)

    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    full = sides.join(intervals.drop("lo", "hi"), "node")
    links = full.groupBy("a", "b").applyInArrow(_compare(turns, kind, limit, LEAST_ROWS), "gid long, links long, a long, b long")
    links = stored(links, "grid-links")

    several = usable.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("vec_id")
    ties = usable.join(several, "vec_id").join(once.select("print", "rep"), "print").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    labels = stored(connected(links.select("a", "b").unionByName(ties).where("a <> b")), "grid-labels")
    others = links.groupBy("gid").agg(F.sum("links").alias("others"))
    found = once.select("gid", "rep", "print", "times").join(others, "gid", "left").join(labels, F.col("rep") == labels["node"], "left")
    found = found.select("print", "times", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("comp", "rep").alias("comp"))
    out = _with_copies(placed.select("vec_id", "print"), stored(found, "grid-found"))
    component = F.coalesce("comp", "vec_id")
    same = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), same.alias("kept"))
