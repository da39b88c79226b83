"""Vector search: exact neighbours, node centroids, routing and placement by affinity.

Tables: vectors (file_id, node_id, embedding).  A query vector is a literal, so scoring is a projection and top-k a
TakeOrderedAndProject; no table is joined to itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scalars as S
from ..functions import vectors as V
from ..functions.text import tokens

#: Query vectors of one block, and vectors; query vectors that are broadcast at most.
BATCH, ROWS, MOST_BROADCAST = 64, 256, 100_000


def register(vectors: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Upsert by file_id; embeddings are checked and brought to unit length."""
    fresh = new.withColumn("embedding", V.unit(V.checked(V.doubles(F.col("embedding")), dim)))
    return vectors.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("file_id").distinct(), "file_id", "left_anti")


def scored(vectors: DataFrame, query: Sequence[float], nodes: Sequence | None = None) -> DataFrame:
    """``vectors`` with a column score; the node filter comes before the scoring."""
    rows = vectors if nodes is None else vectors.where(F.col("node_id").isin(list(nodes)))
    return rows.withColumn("score", V.cosine(V.doubles(F.col("embedding")), V.literal(query)))


def knn(vectors: DataFrame, query: Sequence[float], k: int = 10, nodes: Sequence | None = None) -> DataFrame:
    """file_id, node_id, score of the ``k`` most similar documents; ties by file_id; k = 0 gives none."""
    return scored(vectors, query, nodes).select("file_id", "node_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(k)


def batch_similarity(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, file_id, score of a stated set of queries (query_id, embedding) against all rows.

    The queries go in blocks of BATCH, the vectors in blocks of ROWS, each a row; a block of each makes a product of matrices, in
    which lengths are taken once.  Every vector meets every query: the rows are as many.  Vectors with a null, or of another dimension than
    a query, have a null score.
    """
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    sides = []
    for rows, key, size in ((queries, "query_id", BATCH), (vectors, "file_id", ROWS)):
        number = max(1, -(-rows.count() // size))
        own = rows.select(F.col(key).alias("id"), V.doubles(F.col("embedding")).alias("v")).withColumn("block", block(number))
        # by number, so that few bytes don't become one task: the work is in the products
        own = own.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
        sides.append((number, own.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("xs"))))
    (number, asked), (_, held) = sides
    asked = asked.withColumnRenamed("xs", "qs")
    asked = F.broadcast(asked) if number * BATCH <= MOST_BROADCAST else asked
    out = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("file_id", vectors.schema["file_id"].dataType), StructField("score", DoubleType())])
    arrow = to_arrow_schema(out)

    def matrix(own: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors as rows, and which of them are of this dimension and without a null."""
        fits = pa.compute.equal(own.value_lengths(), dim).fill_null(False).to_numpy(zero_copy_only=False)
        values = own.filter(pa.array(fits)).flatten()
        rows = np.zeros((len(own), dim))
        rows[fits] = values.to_numpy(zero_copy_only=False).reshape(int(fits.sum()), dim)
        whole = fits.copy()
        whole[fits] = ~values.is_null().to_numpy(zero_copy_only=False).reshape(int(fits.sum()), dim).any(axis=1)
        return rows, whole

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v in zip(batch.column("qs"), batch.column("xs")):
                q, v = q.values, v.values
                sizes = q.field("v").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes).tolist():
                    own = q.filter(pa.array(sizes == dim))
                    (a, told), (b, whole) = (matrix(x.field("v"), max(dim, 0)) for x in (own, v))
                    lengths = [np.sqrt((x * x).sum(axis=1)) + V.GUARD for x in (a, b)]
                    scores = (a @ b.T) / (lengths[0][:, None] * lengths[1][None, :])
                    unknown = ~(told[:, None] & whole[None, :])
                    ids = [own.field("id").take(pa.array(np.repeat(np.arange(len(own)), len(v)))), v.field("id").take(pa.array(np.tile(np.arange(len(v)), len(own))))]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(scores.reshape(-1), mask=unknown.reshape(-1))], ["query_id", "file_id", "score"]).cast(arrow)

    met = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).join(asked, "block").select("qs", "xs")
    return met.mapInArrow(score, out).withColumn("score", F.round("score", 6))


def embedded(documents: DataFrame, dim: int = 384, name: str = "name", content: str = "content", description: str = "description", tags: str = "tags") -> DataFrame:
    """``documents`` with a column embedding of what ``document_text`` makes of name, content, description and tags.

    The external model isn't available here: ``hashed_embedding`` stands in.
    """
    return documents.withColumn("embedding", V.hashed_embedding(tokens(S.document_text(*map(F.col, (name, content, description, tags)))), dim))


def embedded_query(spark: SparkSession, query: str, dim: int = 384) -> list[float]:
    """The embedding of a query's text, by the same stand-in."""
    return list(spark.range(1).select(V.hashed_embedding(tokens(F.lit(query)), dim)).first()[0])


def centroid_parts(vectors: DataFrame) -> DataFrame:
    """node_id, pos, value: the mean unit vector of each node at unit length, one row for each position.

    Sums are combined in each task before the shuffle, so a node with most documents costs no more than another.
    """
    parts = vectors.select("node_id", F.posexplode(V.unit(V.doubles(F.col("embedding")))).alias("pos", "x")).groupBy("node_id", "pos").agg(F.avg("x").alias("mean"))
    lengths = parts.groupBy("node_id").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
    return parts.join(lengths, "node_id").select("node_id", "pos", (F.col("mean") / (F.col("length") + F.lit(V.GUARD))).alias("value"))


def centroids(vectors: DataFrame) -> DataFrame:
    """node_id, centroid, document_count."""
    arrays = centroid_parts(vectors).groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centroid"))
    return arrays.join(vectors.groupBy("node_id").agg(F.count(F.lit(1)).alias("document_count")), "node_id")


def route(vectors: DataFrame, query: Sequence[float], k: int = 3) -> DataFrame:
    """node_id, score: the ``k`` nodes whose centroids are most similar; ties by node_id."""
    return centroids(vectors).select("node_id", F.round(V.cosine(F.col("centroid"), V.literal(query)), 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def routed_search(vectors: DataFrame, query: Sequence[float], nodes: int = 3, k: int = 10, dedup: str = "first") -> DataFrame:
    """Route to the best ``nodes``, take the best 2k of each, drop repeated files, keep the best k.

    dedup: of a file on several nodes the row of the better node stays (first), or the better score (best).
    """
    chosen = route(vectors, query, nodes).select("node_id", F.col("score").alias("node_score"))
    own = Window.partitionBy("node_id").orderBy(F.desc("score"), "file_id")
    best = scored(vectors.join(F.broadcast(chosen), "node_id"), query).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= 2 * k)
    order = [F.desc("node_score"), "node_id"] if dedup == "first" else [F.desc("score"), "node_id"]
    once = best.withColumn("seen", F.row_number().over(Window.partitionBy("file_id").orderBy(*order))).where("seen = 1")
    return once.select("file_id", "node_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(k)


def routing_recall(vectors: DataFrame, query: Sequence[float], nodes: int = 3, k: int = 10) -> DataFrame:
    """k, found, recall of routed search against the exact one."""
    hit = knn(vectors, query, k).select("file_id").join(routed_search(vectors, query, nodes, k).select("file_id"), "file_id", "left_semi")
    return hit.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("found")).withColumn("recall", F.round(F.col("found") / F.col("k"), 6))


#: Nodes whose centroids are one block.
NODES_AT_ONCE = 256


def replica_nodes(vectors: DataFrame, replication_factor: int = 2) -> DataFrame:
    """file_id, node_id, score, nth: for each document the nodes most similar to it, its own left out.

    Centroids go in blocks of NODES_AT_ONCE, each a row; a document meets the blocks one by one, keeps the best of each,
    and the best of those count.  With one block nothing is shuffled but the blocks.
    """
    held = centroids(vectors).select(F.col("node_id").cast("string").alias("node_id"), "centroid")
    number = max(1, -(-held.count() // NODES_AT_ONCE))
    blocks = held.groupBy(F.pmod(F.xxhash64("node_id"), F.lit(number)).cast("int").alias("block")).agg(F.collect_list(F.struct("node_id", "centroid")).alias("spots"))
    near = F.transform(
        F.filter("spots", lambda s: ~s["node_id"].eqNullSafe(F.col("own").cast("string"))),
        lambda s: F.struct((-F.round(V.cosine(F.col("v"), s["centroid"]), 6)).alias("less"), s["node_id"].alias("node_id")),
    )
    rows = vectors.select("file_id", F.col("node_id").alias("own"), V.doubles(F.col("embedding")).alias("v"))
    met = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).join(blocks, "block").select("file_id", "own", F.slice(F.array_sort(near), 1, replication_factor).alias("best"))
    if number > 1:
        met = met.groupBy("file_id", "own").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, replication_factor).alias("best"))
    return met.select("file_id", F.posexplode("best").alias("nth", "x")).select("file_id", F.col("x.node_id").alias("node_id"), (-F.col("x.less")).alias("score"), (F.col("nth") + 1).alias("nth"))


def location_stats(vectors: DataFrame) -> DataFrame:
    """node_id, document_count."""
    return vectors.groupBy("node_id").agg(F.count(F.lit(1)).alias("document_count"))


def locate(vectors: DataFrame, file_id) -> DataFrame:
    return vectors.where(F.col("file_id") == file_id)


def documents_in(vectors: DataFrame, node_id) -> DataFrame:
    return vectors.where(F.col("node_id") == node_id)


def fused(*ranked: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of short result lists (file_id, score): file_id, score."""
    parts = None
    for r in ranked:
        own = r.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "file_id"))).select("file_id", (1 / (F.col("nth") + constant)).alias("part"))
        parts = own if parts is None else parts.union(own)
    return parts.groupBy("file_id").agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(k)
