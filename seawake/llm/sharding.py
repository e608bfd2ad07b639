"""Shards of near equal bytes by histogram sort.

Rows are ordered by a hash of their text, then ``doc_id``, then a row number: equal texts stay
together, everything else is spread evenly, and no two rows are equal.  Shards are stretches of
that order.  Their borders (splitters) are found without sorting anything:

1. every open border has an interval of keys it must lie in, and a few probes inside it;
2. one pass counts the exact bytes and rows between neighbouring probes, partition by partition, and
   the smallest and largest key seen there;
3. the interval shrinks to the two probes around the border's target, cut to the keys that exist;
   a border is done when a probe meets the tolerance or one row is left between the probes.

Then one exchange moves every row to its place.  Besides the shard borders, looser ones cut each
shard into parts, so a shard never has to fit a task; the histogram also tells how many rows lie
before each part, which turns a rank within a part into a slot within the shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seawake.llm.common import shuffle_width, stored

KEY = ["_h", "_d", "_r"]
_BYTES = 8 * len(KEY)
_TOP = 1 << (8 * _BYTES)


def packed_keys(*columns) -> np.ndarray:
    """Signed 64-bit columns as fixed byte strings that sort like the tuple of values."""
    out = np.empty((len(columns[0]), len(columns)), ">u8")
    for i, c in enumerate(columns):
        out[:, i] = np.asarray(c, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view(f"S{8 * len(columns)}").ravel()


def _as_keys(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(_BYTES, "big") for p in probes], f"S{_BYTES}")


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(_BYTES, b"\0"), "big")


def _histogram(probes: list[int]):
    """Per partition and bucket (keys at or after probe i-1, before probe i): bytes, rows, least and largest key."""
    bounds = _as_keys(probes)

    def run(frames):
        total: dict[int, list] = {}
        for f in frames:
            if not len(f):
                continue
            keys = packed_keys(*(f[c].to_numpy() for c in KEY))
            order = np.argsort(keys)
            keys, sizes = keys[order], f["_size"].to_numpy()[order]
            bucket = np.searchsorted(bounds, keys, "right")
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[at[1:], len(keys)]
            for b, i, j, s in zip(bucket[at].tolist(), at, ends, np.add.reduceat(sizes, at)):
                t = total.setdefault(b, [0, 0, keys[i], keys[j - 1]])
                t[0] += int(s)
                t[1] += int(j - i)
                t[2], t[3] = min(t[2], keys[i]), max(t[3], keys[j - 1])
        if total:
            rows = [(b, s, n, lo.ljust(_BYTES, b"\0"), hi.ljust(_BYTES, b"\0")) for b, (s, n, lo, hi) in total.items()]
            yield pd.DataFrame(rows, columns=["b", "size", "n", "lo", "hi"])

    return run


class Border:
    """One border to find: the probe before which ``target`` bytes lie, give or take ``slack``."""

    def __init__(self, target: int, slack: float):
        self.target, self.slack = target, slack
        self.lo, self.hi = 0, _TOP - 1  # the border lies after lo and at or before hi
        self.at = None

    def probes(self, n: int) -> list[int]:
        width = self.hi - self.lo
        return sorted({self.lo + max(1, width * i // n) for i in range(1, n + 1)} if width > 0 else {self.hi})


def splitters(keys: DataFrame, targets: list[tuple[int, float]], per_border: int = 15):
    """Borders for ``(target bytes, slack)`` and, for each, the exact bytes and rows before it.

    ``keys`` holds the key columns and ``_size``.  What comes to the driver are the counts
    between probes: at most ``per_border`` + 1 rows per border and round, however many rows there are.
    """
    borders = [Border(t, s) for t, s in targets]
    while open_ := [b for b in borders if b.at is None]:
        probes = sorted({p for b in open_ for p in b.probes(per_border)})
        parts = keys.mapInPandas(_histogram(probes), "b int, size long, n long, lo binary, hi binary")
        got = {
            r["b"]: r
            for r in parts.groupBy("b")
            .agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .collect()
        }
        size = np.array([got[i]["size"] if i in got else 0 for i in range(len(probes) + 1)], np.int64)
        rows = np.array([got[i]["n"] if i in got else 0 for i in range(len(probes) + 1)], np.int64)
        size_before, rows_before = np.cumsum(size), np.cumsum(rows)  # before probe i: buckets 0..i
        for b in open_:
            i = int(np.searchsorted(size_before[: len(probes)], b.target))
            choices = [j for j in (i - 1, i) if 0 <= j < len(probes)]
            best = min(choices, key=lambda j: abs(int(size_before[j]) - b.target))
            if abs(int(size_before[best]) - b.target) <= b.slack or i in got and got[i]["n"] <= 1 and 0 < i < len(probes):
                b.at = (probes[best], int(size_before[best]), int(rows_before[best]))
                continue
            if i not in got or i == len(probes) and got[i]["n"] <= 1:
                b.at = (probes[best], int(size_before[best]), int(rows_before[best]))
                continue
            # the border lies among the keys of bucket i: at its first key nothing of it is before
            b.lo, b.hi = max(b.lo, _number(got[i]["lo"]) - 1), min(b.hi, _number(got[i]["hi"]) + 1)
    return [b.at for b in borders]


def shard_by_bytes(
    docs: DataFrame, shards: int, size, group, tolerance: float = 0.001, parts: int | None = None
) -> DataFrame:
    """Every row with ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``size`` and ``group`` are expressions: the bytes of a row, and the value whose equal rows stay
    together where the borders allow it.  A shard border is off its exact place by at most
    ``tolerance`` of a shard or by half the row it falls into.  All columns are kept; columns of
    the names this adds are replaced.  NULL ``doc_id`` and NULL groups sort before all others,
    rows alike in everything are told apart by a row number.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    # the given columns travel in one, so that none can clash with those added here
    keyed = docs.select(
        F.struct(*names).alias("row"),
        size.cast("long").alias("_size"),
        F.xxhash64(group).alias("_h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_d"),
        F.monotonically_increasing_id().alias("_r"),
    )
    table = stored(keyed, "sharding")
    total = table.agg(F.sum("_size").alias("s")).first()["s"]
    if not total:
        return table.select("row.*", F.col("_size").alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    fine = max(1, -(-(parts or shuffle_width(spark)) // shards))
    cuts = shards * fine
    each = total / shards
    targets = [
        (round(total * i / cuts), each * (tolerance if i % fine == 0 else 0.25 / fine)) for i in range(1, cuts)
    ]
    found = splitters(table.select(*KEY, "_size"), targets)
    # loose borders may come to lie on or behind a neighbour; the shard borders stay in order
    bounds, before = [], [0]
    for i, (probe, _, rows) in enumerate(found, 1):
        if bounds and probe < bounds[-1]:
            probe, rows = bounds[-1], before[-1]
        bounds.append(probe)
        before.append(rows)
    limits = _as_keys(bounds)

    @F.pandas_udf("int")
    def part_of(h: pd.Series, d: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, packed_keys(h, d, r), "right").astype(np.int32))

    offset = [n - before[i - i % fine] for i, n in enumerate(before)]
    placed = table.withColumn("_part", part_of(*KEY)).repartitionByRange(cuts, "_part")
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*KEY)) - 1
    starts = F.array(*[F.lit(o).cast("long") for o in offset])
    return placed.select(
        "row.*",
        F.col("_size").alias("size"),
        F.floor(F.col("_part") / fine).cast("int").alias("shard"),
        (rank + F.element_at(starts, F.col("_part") + 1)).cast("long").alias("slot"),
    )
