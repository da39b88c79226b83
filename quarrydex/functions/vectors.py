"""Vector columns, without leaving the JVM but for the stand-in of a model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-10


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    length = norm(a) + F.lit(GUARD)
    return F.transform(a, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(GUARD)) * (norm(b) + F.lit(GUARD)))


def checked(vector: Column, dim: int) -> Column:
    """The vector; the job fails on another dimension."""
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.format_string(f"embedding has %d dimensions, not {dim}", F.size(vector))).cast("array<double>"))


def _sums(dim: int):
    """A column function: sums of signs by position, of unit length; one pass over a row's tokens, however many dimensions."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at = batch.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(pa.compute.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            start = np.concatenate(([0], ends[:-1])).astype(np.int64)
            out = np.zeros((len(batch), dim))
            for row, a, b in zip(out, start.tolist(), ends.tolist()):
                own = at[a:b]  # positions from 1, with the token's sign
                row += np.bincount(np.abs(own) - 1, np.sign(own), dim)[:dim]
            out /= np.sqrt((out * out).sum(axis=1, keepdims=True)) + GUARD
            yield pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), dim).cast(pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def hashed_embedding(tokens: Column, dim: int = 384) -> Column:
    """A stand-in for an external model: signed token hashes, summed by position, of unit length; no tokens are a zero vector."""
    place = lambda t: (F.pmod(F.xxhash64(t), F.lit(dim)) + 1).cast("int")
    return _sums(dim)(F.transform(tokens, lambda t: F.when(F.xxhash64(t, F.lit("sign")) < 0, -place(t)).otherwise(place(t))))
