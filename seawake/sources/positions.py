"""Position-report sources (SRC1-SRC5)."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.plans.joins import semi_filter
from seawake.schema import POINT_SCHEMA

# Accepted header spellings (after trimming, lower-casing and removing
# blanks, hyphens and underscores) and the column each one fills.
HEADER_ALIASES = {
    "mmsi": "mmsi",
    "basedatetime": "base_date_time",
    "timestamp": "base_date_time",
    "lat": "latitude",
    "latitude": "latitude",
    "lon": "longitude",
    "long": "longitude",
    "longitude": "longitude",
    "sog": "sog",
    "cog": "cog",
    "heading": "heading",
    "vesselname": "vessel_name",
    "name": "vessel_name",
    "imo": "imo",
    "callsign": "call_sign",
    "vesseltype": "vessel_type",
    "status": "status",
    "length": "length",
    "width": "width",
    "draft": "draft",
    "cargo": "cargo",
    "transcieverclass": "transceiver",
    "transceiver": "transceiver",
}

REQUIRED = ("mmsi", "base_date_time", "latitude", "longitude")

SPARK_CHARSETS = {"ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "UTF-8"}

_BOM = "\ufeff"


def normalise_header(name: str) -> str:
    name = name.replace(_BOM, "").strip().lower()
    return name.replace(" ", "").replace("-", "").replace("_", "")


def map_headers(headers: Iterable[str]) -> dict[str, str]:
    """Target column -> source header; the first matching header wins."""
    found: dict[str, str] = {}
    for header in headers:
        target = HEADER_ALIASES.get(normalise_header(header))
        if target is not None:
            found.setdefault(target, header)
    return found


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def type_positions(raw: DataFrame) -> DataFrame:
    """All-text columns under any accepted headers to the typed point schema.

    Values are trimmed, empty text is NULL, a value that does not parse is NULL, a missing
    column is NULL.
    """
    found = map_headers(raw.columns)
    cols = []
    for field in POINT_SCHEMA.fields:
        if field.name in found:
            text = F.nullif(F.trim(_quoted(found[field.name])), F.lit(""))
            cols.append(text.try_cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return raw.select(*cols)


def rejected_rows(raw: DataFrame) -> DataFrame:
    """Rows of an all-text frame with at least one value that does not parse."""
    bad = F.lit(False)
    for target, header in map_headers(raw.columns).items():
        text = F.nullif(F.trim(_quoted(header)), F.lit(""))
        bad = bad | (text.isNotNull() & text.try_cast(POINT_SCHEMA[target].dataType).isNull())
    return raw.where(bad)


def read_text_columns(
    spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8", glob: str | None = None
) -> DataFrame:
    if encoding.upper() not in SPARK_CHARSETS:
        # Spark reads its standard charsets only unless told otherwise
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("encoding", encoding)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def header_groups(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None, glob: str | None = None
) -> dict[tuple[str, str], list[str]]:
    """Files by (encoding, header line).  Without ``encoding`` a file with any line that is not UTF-8 is taken for GBK.

    One streamed pass over the whole files, by the executors: the text source hands on the bytes of
    each line as they are (no byte of a GBK character is a line end), and one row per
    file comes back.  The header is the first line that is not blank; files without one are left out.
    """
    reader = spark.read
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        "value",
        # rows of one split are read in order, so the least number of the first split is the first line's
        F.when((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""), F.monotonically_increasing_id()).alias("row"),
    )
    # the set of two values at most makes this a hash aggregate, text buffers notwithstanding
    files = lines.groupBy("path").agg(
        F.collect_set(F.is_valid_utf8("value")).alias("valid"),
        F.min_by(F.col("value").cast("binary"), "row").alias("header"),
    )
    groups: dict[tuple[str, str], list[str]] = {}
    for r in files.orderBy("path").collect():
        found = encoding or ("GBK" if False in r["valid"] else "UTF-8")
        header = bytes(r["header"] or b"").decode(found, "replace").lstrip("\ufeff")
        if header.strip():
            groups.setdefault((found, header), []).append(r["path"])
    return groups


def read_positions_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str | None = None,
    glob: str | None = None,
) -> DataFrame:
    """SRC1, SRC3, SRC4: position CSV files to typed points.

    ``paths`` is a file, a directory or a list; pass ``glob='*.csv'`` to filter a directory.  Every file
    is read by its own header: files that share one are one scan.  A file whose header lacks the
    vessel, the time or the position is skipped.  ``encoding`` holds for all files; left out, it is
    UTF-8 (with or without a mark) or else GBK, file by file.
    """
    out = None
    for (found, header), files in header_groups(spark, paths, encoding, glob).items():
        if any(c not in map_headers(next(csv.reader([header]))) for c in REQUIRED):
            continue
        part = type_positions(read_text_columns(spark, files, found))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], POINT_SCHEMA) if out is None else out


def clean_points(df: DataFrame, ts_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """SRC2: coerce time (one strict format) and numbers, drop incomplete or off-globe rows.

    Accepts an all-text frame under any accepted headers or already typed points.  A frame
    that lacks a required column gives no rows.
    """
    found = map_headers(df.columns)
    types = dict(df.dtypes)
    if any(c not in found for c in REQUIRED):
        return df.sparkSession.createDataFrame([], POINT_SCHEMA)
    cols = []
    for field in POINT_SCHEMA.fields:
        if field.name not in found:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        src = _quoted(found[field.name])
        if types[found[field.name]] != "string":
            value = src.cast(field.dataType)
        elif field.name == "base_date_time":
            value = F.try_to_timestamp(F.trim(src), F.lit(ts_format))
        else:
            value = F.nullif(F.trim(src), F.lit("")).try_cast(field.dataType)
        cols.append(value.alias(field.name))
    extra = [c for c in ("src_id",) if c in df.columns]
    return (
        df.select(*cols, *extra)
        .na.drop(subset=list(REQUIRED))
        .where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    )


def points_of_vessels(points: DataFrame, vessels: DataFrame | Sequence[int]) -> DataFrame:
    """SRC5: reports of the listed vessels.

    A short Python list is pushed into the scan as ``IN``; a DataFrame becomes a semi join.
    """
    if isinstance(vessels, DataFrame):
        return semi_filter(points, vessels, ["mmsi"])
    return points.where(F.col("mmsi").isin(list(vessels)))
