"""Parts the text operators share: reading, intermediate tables, and word memos."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes that separate words in every contract here: space and 0x09-0x0D, what ``bytes.split()`` uses
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: documents are handed to numpy and the tokenizers in slices of this many, so memory stays small
SLICE_DOCS = 256
#: and of some so many bytes, one document at least
SLICE_TEXT = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader so that any path Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends.

    ``spark.checkpoint.dir`` names a folder all executors share.  Only on a local master,
    where driver and executors are one process, an unset value falls back to a temporary one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="seawake-llm-")
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return str(fs.makeQualified(path).toString())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    The written table cuts the lineage: a lost executor costs a re-read, not a recompute, and
    values such as row numbers no longer change.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: bytes of rows that Spark hands to Python at once
BATCH_BYTES = "4m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, unless it has a bound of its own.

    Spark's bound of 64 MB holds a whole split of texts.  Each task has such a batch several times over: where it is
    built and sent, and in Python, which reads the next before the last is let go.  The rows are the same.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text="text"):
    """The text as UTF-8 bytes, empty for NULL."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def quiet_tokenizers() -> None:
    """Spark runs one task per core, so the library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


_loaded: dict = {}


def load_tokenizer(path: str):
    """The tokenizer file, loaded once per Python worker, without padding or truncation."""
    if path not in _loaded:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _loaded[path] = t
    return _loaded[path]


def slices(batch, *names):
    """Python lists of the named columns of an Arrow batch, ``SLICE_DOCS`` rows or some ``SLICE_TEXT`` bytes at a time."""
    import pyarrow as pa

    places = [batch.schema.get_field_index(n) for n in names]
    text = next((i for i in places if pa.types.is_binary(batch.schema.field(i).type)), None)
    for at in range(0, batch.num_rows, SLICE_DOCS):
        rows = batch.slice(at, SLICE_DOCS)
        for part in [rows] if text is None else byte_slices(rows, text, SLICE_TEXT):
            yield tuple(part.column(i).to_pylist() for i in places)


#: bytes of a column that are handed on at once, where texts differ much in length
SLICE_BYTES = 1 << 20


def byte_slices(batch, column: int, size: int | None = None):
    """Parts of an Arrow batch whose binary ``column`` holds about ``size`` bytes, at least one row each."""
    import numpy as np

    body = batch.column(column)
    ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    starts = ends[:-1] - ends[0] if len(ends) else ends
    cuts = (np.flatnonzero(np.diff(starts // (size or SLICE_BYTES))) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(body)]):
        if b > a:
            yield batch.slice(a, b - a)
