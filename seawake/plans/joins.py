"""Joins Spark has no operator for: banded time joins and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: a side is broadcast only if a count proves it has no more rows and bytes than this
BROADCAST_WEIGHT = 200_000
BROADCAST_BYTES = 32 << 20
#: copies of the smaller side of a shuffled join whose keys may be hot
SALTS = 16


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes, from its types and the lengths of its strings and lists."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            flat = isinstance(kind.elementType, T.StructType) and all(_fixed(f.dataType) for f in kind.elementType)
            if flat or _fixed(kind.elementType):
                width = 8 * len(kind.elementType) + 16 if flat else 8
                return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * width + 16
            return F.coalesce(F.aggregate(F.transform(c, lambda x: of(x, kind.elementType)), F.lit(16), lambda s, x: s + x), F.lit(16))
        if isinstance(kind, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in kind), F.lit(16))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema), F.lit(16).cast("long"))


def _fixed(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))


def fits_broadcast(df: DataFrame, weight: Column | None = None, limit: int = BROADCAST_WEIGHT) -> bool:
    """Whether ``df`` is proven small: rows (or the sum of ``weight``, at least one per row) and bytes within bounds.

    The probe reads at most ``limit + 1`` rows.
    """
    w = F.lit(1) if weight is None else F.greatest(F.coalesce(weight.cast("long"), F.lit(1)), F.lit(1))
    probe = df.select(w.alias("w"), row_bytes(df).alias("b")).limit(limit + 1)
    found = probe.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return found["n"] <= limit and found["b"] <= BROADCAST_BYTES


def sized_broadcast(df: DataFrame, weight: Column | None = None, limit: int = BROADCAST_WEIGHT) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size is within ``limit`` and ``BROADCAST_BYTES``.

    A larger frame is returned unchanged and Spark shuffles, with AQE splitting skewed partitions.
    """
    return F.broadcast(df) if fits_broadcast(df, weight, limit) else df


def salted_join(left: DataFrame, right: DataFrame, on: list[str], weight: Column | None = None) -> DataFrame:
    """Inner join of rows with a dimension; keys may be hot on the left.

    A small ``right`` is broadcast.  A larger one is copied ``SALTS`` times, and the rows of a key on the left are
    dealt to the copies, so no task gets all rows of a hot key.
    """
    if fits_broadcast(right, weight):
        return left.join(F.broadcast(right), on)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = [c for c in left.columns if c not in on]  # a salt that a repeated task finds again
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")


def with_span_buckets(
    df: DataFrame, start: Column, end: Column, width_s: float, name: str = "bucket"
) -> DataFrame:
    """One row per time bucket an interval ``[start, end]`` touches."""
    w = F.lit(int(width_s * 1_000_000))
    return df.withColumn(
        name, F.explode(F.sequence(F.floor(F.unix_micros(start) / w), F.floor(F.unix_micros(end) / w)))
    )


def fullest(df: DataFrame, top: int | None, *order) -> DataFrame:
    """The first ``top`` rows in ``order``, or all of them, unordered, with ``top=None``."""
    return df if top is None else df.orderBy(*order).limit(top)


def semi_filter(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Keep rows whose key occurs in ``keys`` (``IN`` list of any length)."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by ``keys`` for Python groups, keeping every shuffle partition.

    AQE merges partitions by bytes; small rows with much work per group would end in one
    Python worker.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
