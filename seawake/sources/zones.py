"""Zone input (SRC7): GeoJSON polygons to the zone dimension.

A zone row is ``zone_id, name, ring, edges, box``; ``edges`` covers all rings of the
polygon and ``box`` is ``struct<xmin,xmax,ymin,ymax>``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.functions.geo import ring_edges

# Fixed value: prefix of the name of an unnamed zone.
DEFAULT_ZONE_NAME = "禁区"

_RINGS = "array<array<array<double>>>"


def ring_box(edges: Column) -> Column:
    return F.struct(
        F.array_min(F.transform(edges, lambda e: e["x1"])).alias("xmin"),
        F.array_max(F.transform(edges, lambda e: e["x1"])).alias("xmax"),
        F.array_min(F.transform(edges, lambda e: e["y1"])).alias("ymin"),
        F.array_max(F.transform(edges, lambda e: e["y1"])).alias("ymax"),
    )


def zones_from_geojson(source: DataFrame | Sequence[str | dict], spark: SparkSession | None = None) -> DataFrame:
    """Zones from a list (texts or dicts) or a frame with ``ordinal`` and ``geojson``.

    Each item is a bare Polygon or ``{"name": …, "geometry": Polygon}``; anything else is
    ignored.  A missing name becomes ``DEFAULT_ZONE_NAME`` and the ordinal, counted from 1 over all items.
    """
    if not isinstance(source, DataFrame):
        spark = spark or SparkSession.getActiveSession()
        rows = [(i, g if isinstance(g, str) else json.dumps(g)) for i, g in enumerate(source, 1)]
        source = spark.createDataFrame(rows, "ordinal int, geojson string")
    text = F.col("geojson")
    inner = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    rings = F.from_json(F.get_json_object(inner, "$.coordinates"), _RINGS)
    xy = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return (
        source.where(F.get_json_object(inner, "$.type") == "Polygon")
        .select(
            F.col("ordinal").cast("int").alias("zone_id"),
            F.coalesce(
                F.nullif(F.trim(F.get_json_object(text, "$.name")), F.lit("")),
                F.concat(F.lit(DEFAULT_ZONE_NAME), F.col("ordinal").cast("string")),
            ).alias("name"),
            F.transform(rings, xy).alias("_rings"),
        )
        .where(F.size("_rings") > 0)
        .withColumn("ring", F.col("_rings")[0])
        .withColumn("edges", F.flatten(F.transform("_rings", ring_edges)))
        .withColumn("box", ring_box(F.col("edges")))
        .drop("_rings")
    )


def zones_or_area(zones: Sequence | None, area: str | dict | None, spark: SparkSession | None = None) -> DataFrame:
    """The zone list, or the single area of older callers when there is no list."""
    return zones_from_geojson(zones if zones else [area] if area else [], spark)
