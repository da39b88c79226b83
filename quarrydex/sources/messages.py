"""Datagrams as a stream: framed messages from files that arrive in a folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Bytes before each datagram of a dump that say how long it is, the highest first.
LENGTH_BYTES = 4


def datagrams(content: bytes) -> list[bytes]:
    """The datagrams of a dump; what is left of one that was cut off is the last."""
    out, at = [], 0
    while at < len(content):
        size = int.from_bytes(content[at : at + LENGTH_BYTES], "big")
        out.append(content[at + LENGTH_BYTES : at + LENGTH_BYTES + size])
        at += LENGTH_BYTES + size
    return out


def dump(values: list[bytes]) -> bytes:
    return b"".join(len(v).to_bytes(LENGTH_BYTES, "big") + v for v in values)


def _split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([[] if c is None else datagrams(c) for c in batch.to_pylist()], pa.list_(pa.binary()))


def read_dumps(spark: SparkSession, folder: str, stream: bool = True, files: int | None = None) -> DataFrame:
    """value: every datagram of the dumps in ``folder``, which any of Spark's file systems may have.

    As a stream it takes up new files as they come, ``files`` of them in a batch; which were read is in the query's checkpoint,
    so a restarted query reads each once.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if stream and files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    split = F.arrow_udf(_split, "array<binary>")
    return reader.load(folder).select(F.explode(split("content")).alias("value"))


def read_frames(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """value: a stream of the datagrams that another job writes to ``folder`` as Parquet rows (value binary)."""
    reader = spark.readStream.schema("value binary")
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


def messages(raw: DataFrame) -> DataFrame:
    """type, sender_id, payload, timestamp, malformed of datagrams (value), a stream or not.

    One that isn't a framed message, or has no time, is malformed and has nulls for the rest; a heartbeat's time must be known.
    """
    rows = raw.select(S.unframe(F.col("value")).alias("m"))
    return rows.select("m.*", (F.col("m").isNull() | F.col("m.timestamp").isNull()).alias("malformed"))


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.where("not malformed").drop("malformed")
