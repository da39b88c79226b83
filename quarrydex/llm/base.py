"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Paths that ``new_path`` gave out.
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.  Where none is set, a temporary one for a session on one machine; on a cluster that is an error."""
    path = spark.conf.get(CHECKPOINT_DIR, "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines of the cluster share")
        path = "file://" + tempfile.mkdtemp(prefix="quarrydex-")
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete what this driver's calls wrote to the shared folder so far, and return how many paths; results that weren't written elsewhere are lost with it."""
    jvm, number = spark.sparkContext._jvm, len(_written)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        place = jvm.org.apache.hadoop.fs.Path(_written.pop())
        place.getFileSystem(conf).delete(place, True)
    return number


def spare(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it so that ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(col: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, null as empty."""
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes in ``column``; a longer row stands alone."""
    col = batch.column(column)
    if not len(col):
        return
    size = np.array([0 if n is None else n for n in pa.compute.binary_length(col).to_pylist()], np.int64)
    part = (np.cumsum(size) - size) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(col)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` consecutive values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
