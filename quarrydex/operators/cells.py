"""Exact nearest neighbours with pruning: vectors are dealt to the cells of pivots, and the triangle inequality leaves cells out.

For unit vectors the distance d and the cosine c have d * d = 2 - 2 * c, so the nearest are the most similar.  A vector x in the
cell of pivot p is at least |d(q, p) - d(x, p)| away from a query q; both distances are known without looking at x.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.vectors import GUARD

#: Vectors that pivots are fitted on at most, and rounds of it.
SAMPLE, ROUNDS = 4096, 8
#: Queries that meet the vectors in one pass.
BLOCK = 256
DIGITS = 6
#: Cell of vectors without length: their cosine with anything is 0, which no distance says.
NOWHERE = -1


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a column of lists as doubles."""
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(col), -1) if len(col) else values.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + GUARD)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def pivots_of(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Spherical k-means over the ``sample`` vectors with the least hashes of their ids: a bounded sample, the same in every run."""
    held = vectors.where("embedding is not null").orderBy(F.xxhash64("file_id"), "file_id").limit(sample).select("embedding").collect()
    x = unit(np.array([list(r[0]) for r in held], np.float64)) if held else np.zeros((0, 0))
    x = x[np.linalg.norm(x, axis=1) > 0.5] if len(x) else x
    if not len(x):
        return x
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < min(cells, len(x)) and near.max() > 0:  # each the farthest from those before
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    p = x[chosen]
    for _ in range(ROUNDS):
        own = distances(x, p).argmin(1)
        sums = np.zeros_like(p)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        p = np.where(length > GUARD, sums / np.maximum(length, GUARD), p)
    return p


@dataclass
class Cells:
    """An index under ``path``: vectors by cell with their distance from its pivot."""

    spark: SparkSession
    path: str
    pivots: np.ndarray
    inner: dict[int, float]
    outer: dict[int, float]
    rows: int
    stored: StructType
    counted: list = field(default_factory=list)

    @property
    def compared(self) -> tuple[int, int]:
        """Pairs that the last search compared once its rows were read, of how many; a task that ran twice counts twice."""
        return sum(c.value for c, _ in self.counted), sum(n for _, n in self.counted)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = 64, sample: int = SAMPLE) -> Cells:
        """Write ``vectors`` (file_id, node_id, embedding) by cell.  Pivots come from a bounded sample, every row is stored.

        A null embedding is left out; one of another dimension fails the job.  Vectors of no length have a cell of their own.
        """
        spark = vectors.sparkSession
        rows = vectors.select("file_id", "node_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        pivots = pivots_of(rows, cells, sample)
        stored = StructType([*StructType.fromDDL("cell int, distance double"), *rows.schema])
        kinds = to_arrow_schema(stored)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = unit(matrix(batch.column(2)))
                if len(pivots):
                    d = distances(x, pivots)
                    cell = d.argmin(1)
                    near = d[np.arange(len(x)), cell]
                else:
                    cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
                cell = np.where(np.linalg.norm(x, axis=1) > 0.5, cell, NOWHERE)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(near), *batch.columns], schema=kinds)

        # parts of a cell by id, so that a crowded cell isn't one task
        dealt = rows.mapInArrow(deal, stored)
        dealt.repartition("cell", F.pmod(F.xxhash64("file_id"), F.lit(8))).sortWithinPartitions("cell", "distance").write.partitionBy("cell").parquet(f"{path}/vectors")
        about = spark.read.schema(stored).parquet(f"{path}/vectors").groupBy("cell").agg(F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.count(F.lit(1)).alias("rows"))
        about = spark.createDataFrame([(json.dumps(pivots.tolist()), stored.json(), [tuple(r) for r in about.collect()])], "pivots string, stored string, cells array<struct<cell:int,inner:double,outer:double,rows:bigint>>")
        about.coalesce(1).write.parquet(f"{path}/about")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Cells:
        r = spark.read.parquet(f"{path}/about").first()
        return cls(spark, path, np.array(json.loads(r.pivots)), {c.cell: c.inner for c in r.cells}, {c.cell: c.outer for c in r.cells}, sum(c.rows for c in r.cells), StructType.fromJson(json.loads(r.stored)))

    def neighbours(self, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
        """query_id, rank, file_id, node_id, score: the ``k`` most similar rows of each query (query_id, embedding), ties by file_id.

        The same rows as comparing everything: a first pass over the queries' own cells gives each a radius in which ``k`` rows
        are, a second compares what the triangle inequality leaves within it.  Queries are a stated set that goes in blocks;
        a query without length is as near to all, so it is compared with all.
        """
        kind = queries.schema["query_id"].dataType
        out = StructType([*StructType().add("query_id", kind), self.stored["file_id"], self.stored["node_id"], *StructType.fromDDL("score double")])
        number = max(1, -(-queries.count() // block))
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        found, self.counted = None, []
        for b in range(number):
            held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == b).collect()
            own = self._block(held, k, out)
            found = own if found is None else found.union(own)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("file_id"), "node_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "file_id", "node_id", "score")

    def _block(self, held: list, k: int, out: StructType) -> DataFrame:
        if not held or not self.rows or k <= 0:
            return self.spark.createDataFrame([], out)
        q = unit(np.array([r.embedding for r in held]))
        names = [r.query_id for r in held]
        real = np.linalg.norm(q, axis=1) > 0.5
        to_pivot = distances(q, self.pivots) if len(self.pivots) else np.zeros((len(q), 1))
        vectors = self.spark.read.schema(self.stored).parquet(f"{self.path}/vectors")
        home = np.where(real, to_pivot.argmin(1), NOWHERE - 1)
        near = vectors.where(F.col("cell").isin(sorted(set(home.tolist()))))
        scores = near.mapInArrow(compare(q, names, np.full(len(q), np.inf), to_pivot, k, out, home, None), out)
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = dict(scores.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query_id", "score").collect())
        radius = np.array([np.sqrt(max(0.0, 2 - 2 * (kth[n] - 10.0**-DIGITS))) + 1e-9 if n in kth and real[i] else np.inf for i, n in enumerate(names)])
        cells = [c for c in self.inner if c == NOWHERE or np.any((to_pivot[:, c] - self.outer[c] <= radius) & (self.inner[c] - to_pivot[:, c] <= radius))]
        counted = self.spark.sparkContext.accumulator(0)
        self.counted.append((counted, len(held) * self.rows))
        return vectors.where(F.col("cell").isin(cells)).mapInArrow(compare(q, names, radius, to_pivot, k, out, None, counted), out)


def compare(q: np.ndarray, names: list, radius: np.ndarray, to_pivot: np.ndarray, k: int, out: StructType, home, counted):
    """A function over the stored rows: the ``k`` best of a task for each query, among rows that may be within its radius."""
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cell, distance = col["cell"].to_numpy(), col["distance"].to_numpy()
            x = unit(matrix(col["embedding"]))
            for c in np.unique(cell).tolist():
                rows = np.flatnonzero(cell == c)
                asked = np.arange(len(q)) if home is None else np.flatnonzero(home == c)
                for i in asked.tolist():
                    own = rows if c == NOWHERE else rows[np.abs(to_pivot[i, c] - distance[rows]) <= radius[i]]
                    if not len(own):
                        continue
                    if counted is not None:
                        counted.add(len(own))
                    score = np.round(x[own] @ q[i], DIGITS) + 0.0
                    if len(own) > k:
                        own, score = own[score >= -np.partition(-score, k - 1)[k - 1]], score[score >= -np.partition(-score, k - 1)[k - 1]]
                    new = pa.table([pa.array([names[i]] * len(own), kinds.field("query_id").type), col["file_id"].take(pa.array(own)), col["node_id"].take(pa.array(own)), pa.array(score)], schema=kinds)
                    held = pa.concat_tables([best[i], new]) if i in best else new
                    best[i] = held.sort_by([("score", "descending"), ("file_id", "ascending"), ("node_id", "ascending")]).slice(0, k)
        for held in best.values():
            yield from held.combine_chunks().to_batches()

    return run
