"""Operator 12: ranked lexical search with Block-Max WAND.

Documents are indexed in shards of bounded size; a shard's postings are blocks of
128, compressed, with the greatest impact of each beside them.  Every query item
meets every shard; blocks that cannot reach the best documents found so far are
passed by before they are decompressed.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.blockmax import Floors, Postings, best, pack
from .base import new_path, strings
from .decontaminate import words

#: Bytes of text in a shard, about; a document is never split.
SHARD_BYTES = 16 << 20
#: Bytes of query text in one block; a block is broadcast, further blocks are further passes over the postings.
BLOCK_BYTES = 4 << 20
#: Hits of an item.
HITS = 50
POSTINGS = "shard bigint, term binary, n bigint, last array<int>, most array<bigint>, width binary, payload binary, norms array<bigint>"


@dataclass(frozen=True)
class Corpus:
    """Documents that have a term, and all their terms."""

    documents: int
    terms: int

    def norm(self, n: int) -> int:
        """What a document's length comes to, 100 for the mean."""
        return 100 - 50 + (50 * n * self.documents) // self.terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * norm)


def corpus_of(docs: DataFrame, text_col: str = "text") -> Corpus:
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([len(words(t)) for t in strings(batch)], pa.int64())

    n = docs.select(F.arrow_udf(count, "bigint")(F.col(text_col)).alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Corpus(n[0], n[1])


def shard_rows(shard: int, texts: list[Counter], corpus: Corpus) -> pa.RecordBatch:
    """Rows of POSTINGS for the term counts of a shard's documents, which are in the order of their ids; the first has the norms."""
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    number = [np.fromiter(map(vocabulary.__getitem__, c), np.int64, len(c)) for c in texts]
    tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in texts])
    place = np.repeat(np.arange(len(texts)), [len(c) for c in texts])
    norms = np.array([corpus.norm(c.total()) for c in texts], np.int64)
    names = sorted(vocabulary)
    rank = np.empty(len(names), np.int64)
    rank[[vocabulary[w] for w in names]] = np.arange(len(names))
    term = rank[np.concatenate(number)]
    order = np.argsort(term, kind="stable")
    term, place, tf = term[order], place[order], tf[order]
    packed = pack(term, place, [tf], impact(tf, norms[place]))
    none = pa.nulls(len(names), pa.list_(pa.int64()))
    rows = pa.RecordBatch.from_arrays([pa.array([shard] * len(names), pa.int64()), pa.array(names, pa.binary()), *packed.values(), none], schema=ROWS)
    about = pa.RecordBatch.from_pylist([{"shard": shard, "term": b"", "n": len(texts), "norms": norms.tolist()}], schema=ROWS)
    return pa.Table.from_batches([about, rows]).combine_chunks().to_batches()[0]


ROWS = pa.schema(
    [
        ("shard", pa.int64()),
        ("term", pa.binary()),
        ("n", pa.int64()),
        ("last", pa.list_(pa.int32())),
        ("most", pa.list_(pa.int64())),
        ("width", pa.binary()),
        ("payload", pa.binary()),
        ("norms", pa.list_(pa.int64())),
    ]
)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Corpus:
    """Write an index of ``docs`` under ``path``: ``postings`` (POSTINGS and ids) and ``corpus`` (documents, terms).

    Terms are the runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lower-cased; null and empty texts have
    none and aren't in the index.  Each task cuts its documents into shards, sorts a shard by id (null ids last, repeated rows
    are documents of their own), and writes its postings sorted by term; a very long document makes a shard of its own.  Two
    passes over the texts, the first of which only counts, and no shuffle.  Columns other than the two named are ignored.
    """
    corpus = corpus_of(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType([*spark_schema(POSTINGS), StructField("ids", _array_of(rows.schema["doc_id"].dataType))])
    ids_type = to_arrow_schema(schema).field("ids").type

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 33, [], 0

        def flushed() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is None, 0 if x[0] is None else x[0]))
            out = shard_rows(shard, [c for _, c in held], corpus)
            ids = pa.array([[i for i, _ in held], *[None] * (len(out) - 1)], ids_type)
            return pa.RecordBatch.from_arrays([*out.columns, ids], [*out.schema.names, "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                if held and size + len(text) > shard_bytes:
                    yield flushed()
                    shard, held, size = shard + 1, [], 0
                if counts := Counter(words(text)):
                    held.append((doc_id, counts))
                    size += len(text)
        if held:
            yield flushed()

    rows.mapInArrow(index, schema).write.parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([(corpus.documents, corpus.terms)], "documents bigint, terms bigint").coalesce(1).write.parquet(f"{path}/corpus")
    return corpus


def spark_schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _array_of(kind):
    from pyspark.sql.types import ArrayType

    return ArrayType(kind)


def queries_of(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[dict]:
    """The terms of each item, in blocks of about ``block_bytes`` of text; items that share an id are one."""
    rows = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("item_text")).where("item_text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    for k in range(n_blocks):
        # by the id, so that what belongs to an item is in one block
        own = rows.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k) if n_blocks > 1 else rows
        terms: dict = {}
        for r in own.toLocalIterator():
            terms.setdefault(r.item, set()).update(words(r.item_text.encode()))
        yield {item: sorted(t) for item, t in terms.items() if t}


def ranked(spark: SparkSession, path: str, items: DataFrame, k: int = HITS, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item over an index, equal scores by ascending id.

    An item's terms count once each; items that share an id (or have none) are one item, null and empty ones have no hits, and
    an empty index or table of items gives an empty result.  Of rows that share an id and a score, each has a rank.  Only the
    postings of the items' terms are read; they are dealt out by shard, whose size is bounded, and a task hands on its
    threshold from shard to shard.  What leaves a task is at most ``k`` rows an item and shard.
    """
    held = spark.read.parquet(f"{path}/corpus").first()
    corpus = Corpus(held.documents, held.terms)
    postings = spark.read.parquet(f"{path}/postings")
    hit = StructType([StructField("item_id", items.schema[item_id].dataType), StructField("doc_id", postings.schema["ids"].dataType.elementType), StructField("score", spark_schema("x bigint")["x"].dataType)])
    kinds = to_arrow_schema(hit)
    found = None
    for queries in queries_of(items, item_id, item_text, block_bytes):
        terms = sorted({t for own in queries.values() for t in own})
        wanted = spark.createDataFrame([(bytearray(t),) for t in [b"", *terms]], "term binary")  # bounded by block_bytes
        rows = postings.join(F.broadcast(wanted), "term", "left_semi")
        df = {bytes(r.term): r.df for r in rows.where("norms is null").groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator()}
        weight = {t: corpus.weight(n) for t, n in df.items()}
        asked = [(item, [(t, weight[t]) for t in own if weight.get(t, 0) > 0]) for item, own in queries.items()]
        shared = spark.sparkContext.broadcast(asked)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            floors, out = Floors(k), {}
            for norms, ids, lists in shards(batches):
                for q, (_, own) in enumerate(shared.value):
                    mine = [(lists[t], w) for t, w in own if t in lists]
                    places, scores = best(mine, len(norms), k, floors.of(q))
                    if len(places):
                        floors.add(q, scores)
                        out.setdefault(q, []).append((scores, ids.take(pa.array(places))))
            for q, parts in out.items():
                scores = np.concatenate([s for s, _ in parts])
                keep = np.flatnonzero(scores >= floors.of(q))
                ids = pa.concat_arrays([i for _, i in parts]).take(pa.array(keep))
                item = pa.array([shared.value[q][0]] * len(keep), kinds.field("item_id").type)
                yield pa.RecordBatch.from_arrays([item, ids.cast(kinds.field("doc_id").type), pa.array(scores[keep].astype(np.int64))], schema=kinds)

        own = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, hit)
        found = own if found is None else found.union(own)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, dict[bytes, Postings]]]:
    """(norms, ids, postings by term) of each shard, from rows that are sorted by shard."""
    shard, norms, ids, rows = None, None, None, []

    def one():
        weigh = lambda place, tf: impact(tf, norms[place])
        return norms, ids, {t: Postings(n, last, most, width, payload, weigh) for t, n, last, most, width, payload in rows}

    for batch in batches:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        ends = np.cumsum(np.nan_to_num(pa.compute.list_value_length(col["last"]).to_numpy(zero_copy_only=False))).astype(np.int64)
        last, most = col["last"].flatten().to_numpy(), col["most"].flatten().to_numpy()
        for i, (number, term, n) in enumerate(zip(col["shard"].to_pylist(), col["term"].to_pylist(), col["n"].to_pylist())):
            if number != shard:
                if shard is not None:
                    yield one()
                shard, rows = number, []
            if term == b"":
                norms, ids = np.array(col["norms"][i].values), col["ids"][i].values
            else:
                a, b = int(ends[i - 1]) if i else 0, int(ends[i])
                rows.append((term, n, last[a:b], most[a:b], col["width"][i].as_py(), col["payload"][i].as_py()))
    if shard is not None:
        yield one()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = HITS) -> DataFrame:
    """The rows of ``ranked`` for an index of ``docs`` that is written for this call."""
    path = new_path(docs.sparkSession, "lexical-index")
    build_index(docs, path)
    return ranked(docs.sparkSession, path, items, k)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY rid, doc_id, n, term),
t AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, rid, doc_id, sum(t.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS score
      FROM q JOIN t ON t.term = q.term JOIN tf ON tf.term = q.term, c GROUP BY item_id, rid, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 50
"""
