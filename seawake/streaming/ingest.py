"""Repeated import as a stream: new CSV files are cleaned and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seawake.sources.positions import clean_points
from seawake.sources.sinks import append_points, write_points


def stream_positions(spark: SparkSession, folder: str, headers: list[str]) -> DataFrame:
    """CSV files arriving in ``folder``, all columns as text under the given headers."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def start_import(raw: DataFrame, table_path: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Append each batch to the point table, existing rows winning.

    A batch that runs again after a failure appends nothing twice, because rows whose
    key is already stored are dropped.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        clean = clean_points(batch)
        try:
            existing = spark.read.parquet(table_path).select("mmsi", "base_date_time")
        except Exception as error:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            existing = clean.select("mmsi", "base_date_time").limit(0)
        write_points(append_points(clean, existing), table_path)

    writer = raw.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()
