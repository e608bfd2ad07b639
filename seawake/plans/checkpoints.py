"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written data.

    The folder is the one the context or ``spark.checkpoint.dir`` names, which on a
    cluster is shared.  Only on a local master, as in tests, an unset one becomes a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="seawake-checkpoint-"))
    return df.checkpoint()
