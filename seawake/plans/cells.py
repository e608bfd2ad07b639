"""Space-time cells of several sizes, on which boxes of any size meet.

A box lies at the level whose cells are just not smaller than itself, so it touches at most two cells along each
axis.  Levels grow by ``STEP``: cells of ``BASE_DEG`` degrees and of ``BASE_S`` seconds (a day) at level 0.  Two boxes
meet at the higher of their levels, space and time each for itself.  So each side is
written once per level that occurs on the other one, at most eight cells each time, and both carry the two
levels in their key: a pair meets at one pair of levels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.functions.geo import seconds
from seawake.plans.joins import salted_join

BASE_DEG, BASE_S, STEP = 1 / 16, 86_400, 4
#: the highest levels: 256 degrees, and 4 ** 8 days
SPACE_LEVELS, TIME_LEVELS = 6, 8


def _level(extent: Column, base: float, highest: int) -> Column:
    """The least level whose cells are not smaller than ``extent``."""
    level = F.lit(highest)
    for n in range(highest - 1, -1, -1):
        level = F.when(extent <= base * STEP**n, n).otherwise(level)
    return level


def with_levels(df: DataFrame, box: str, timed: bool = True) -> DataFrame:
    """Adds the levels ``_sl`` (space) and ``_tl`` (time) of the box column."""
    b = F.col(box)
    extent = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    time = _level(seconds(b["tmax"]) - seconds(b["tmin"]), float(BASE_S), TIME_LEVELS) if timed else F.lit(0)
    return df.withColumns({"_sl": _level(extent, BASE_DEG, SPACE_LEVELS), "_tl": time})


def levels_of(leveled: DataFrame) -> list[tuple[int, int]]:
    """The pairs of levels that occur; at most 63, whatever the input."""
    return sorted((r[0], r[1]) for r in leveled.groupBy("_sl", "_tl").agg(F.count(F.lit(1))).drop("count(1)").collect())


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def covered(leveled: DataFrame, box: str, others: list[tuple[int, int]], first: bool, timed: bool = True) -> DataFrame:
    """Rows of one side with their cells ``_x, _y, _t`` and both sides' levels ``_l1, _l2`` (own and other's)."""
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in others])
    if not others:
        pairs = pairs.cast("array<struct<s:int,t:int>>")
    own, other = (F.col("_sl") * 16 + F.col("_tl")), (F.col("_o.s") * 16 + F.col("_o.t"))
    b = F.col(box)
    deg = F.lit(BASE_DEG) * F.pow(F.lit(float(STEP)), F.greatest(F.col("_sl"), F.col("_o.s")))
    span = F.lit(float(BASE_S)) * F.pow(F.lit(float(STEP)), F.greatest(F.col("_tl"), F.col("_o.t")))
    out = leveled.withColumn("_o", F.explode(pairs))
    out = out.withColumns({"_l1": (own if first else other).cast("int"), "_l2": (other if first else own).cast("int"), "_deg": deg, "_span": span})
    out = out.withColumn("_x", F.explode(_cells(b["xmin"], b["xmax"], F.col("_deg"))))
    out = out.withColumn("_y", F.explode(_cells(b["ymin"], b["ymax"], F.col("_deg"))))
    if timed:
        out = out.withColumn("_t", F.explode(_cells(seconds(b["tmin"]), seconds(b["tmax"]), F.col("_span"))))
    return out.drop("_o", "_sl", "_tl", "_deg", "_span")


def cell_join(left: DataFrame, left_box: str, right: DataFrame, right_box: str, timed: bool = True) -> DataFrame:
    """Pairs of rows whose boxes share a cell, each pair once per cell shared; the caller tests the boxes.

    Two jobs find the levels of both sides.  ``right`` is broadcast if it is small, else both are shuffled by cell.
    Boxes without times meet in space alone (``timed=False``).
    """
    a, b = with_levels(left, left_box, timed), with_levels(right, right_box, timed)
    keys = ["_l1", "_l2", "_x", "_y", *(["_t"] if timed else [])]
    cells = covered(b, right_box, levels_of(a), False, timed)
    return salted_join(covered(a, left_box, levels_of(b), True, timed), cells, keys).drop(*keys)
