"""Connected components of an edge table, by hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import stored


def _roots(parent: DataFrame) -> DataFrame:
    """Follow ``u -> p`` (always downwards) to the end, doubling the step each time."""
    while True:
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        moved = F.col("q").isNotNull()
        parent = stored(
            parent.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), moved.alias("moved")), "components"
        )
        if parent.where("moved").isEmpty():
            return parent.select("u", "p")
        parent = parent.select("u", "p")


def connected(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges (a, b)`` that is not the smallest of its component.

    ``comp`` is the smallest node reachable; nodes left out are their own.  Each round every node
    hooks to its smallest neighbour and the trees collapse to their roots; only edges between
    different roots go on, so both rounds and doublings are logarithmic.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "components")
    labels = None
    while not e.isEmpty():
        parent = _roots(e.groupBy("u").agg(F.min("v").alias("p")))
        hooked = parent.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        if labels is not None:
            up = parent.select(F.col("u").alias("comp"), F.col("p").alias("top"))
            moved = labels.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
            hooked = moved.unionByName(hooked)
        labels = hooked
        pu, pv = (parent.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in ("u", "v"))
        e = e.join(pu, "u", "left").join(pv, "v", "left")
        x, y = F.coalesce("pu", "u"), F.coalesce("pv", "v")
        e = e.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()
        e = stored(e, "components")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    return labels
