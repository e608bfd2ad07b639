"""A bit field of fixed size that says which ids may be in a set.

It keeps rows that cannot take part in a join out of its shuffle.  The field has the same length
however many ids there are, so it can be sent to all tasks; beyond its length ids share bits, which costs
shuffle, never a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import small_batches

ID_BITS = 16_777_213
#: words of a field that travel to the driver in one row
ROW_WORDS = 1 << 13


def folded_bits(places: DataFrame, bits: int) -> np.ndarray:
    """The bit field whose set places are in the only column of ``places``.

    Spark folds them into rows of ``ROW_WORDS`` words, so the driver gets few binary rows, as many for any input.
    """
    column = F.col(places.columns[0])
    words = places.select(column.alias("i")).groupBy(F.expr("i div 32").alias("w"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(i % 32 as int)))").alias("b"))

    def fold(key, table):
        out = np.zeros(ROW_WORDS, "<u4")
        out[table.column("w").to_numpy() % ROW_WORDS] = table.column("b").to_numpy()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(-(-(bits // 32 + 1) // ROW_WORDS) * ROW_WORDS, np.uint32)
    for r in words.groupBy(F.expr(f"w div {ROW_WORDS}").alias("row")).applyInArrow(fold, "row long, data binary").collect():
        at = r["row"] * ROW_WORDS
        out[at : at + ROW_WORDS] = np.frombuffer(r["data"], "<u4")
    return out


def id_bits(ids: DataFrame) -> np.ndarray:
    """The bits of the ids in the only column of ``ids``; NULL counts for none."""
    column = F.col(ids.columns[0])
    return folded_bits(ids.where(column.isNotNull()).select(F.pmod(column, F.lit(ID_BITS)).alias("i")), ID_BITS)


def has_bit(field: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids % ID_BITS
    return (field[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def with_bit(df: DataFrame, column: str, field: np.ndarray, on: bool = True) -> DataFrame:
    """The rows of ``df`` whose id has its bit set, or with ``on=False`` the others; NULL ids count as 0."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).cast(pa.int64()).fill_null(0)
            ids = ids.to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(has_bit(shared.value, ids) == on))

    return df.mapInArrow(run, df.schema)


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``ids``; only rows that may be are shuffled.  NULL ids stay."""
    field = id_bits(ids)
    rest = with_bit(docs, "doc_id", field).join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
    return with_bit(docs, "doc_id", field, False).unionByName(rest.select(docs.columns))
