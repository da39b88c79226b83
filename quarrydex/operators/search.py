"""Full-text search with BM25, field weights, type filter and a fallback on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import beside
from ..functions.text import contains_ignoring_case, query_terms, tokens
from .text_index import K1, B, TextIndex

NAME_WEIGHT, CONTENT_WEIGHT = 10.0, 1.0
#: Hits whose replicas are looked up by their ids, at most.
MOST_NAMED = 1000


def postings(docs: DataFrame, field: str, id_col: str = "file_id") -> DataFrame:
    """term, file_id, field, tf; counts are combined within each task before the shuffle."""
    return docs.select(F.col(id_col).alias("file_id"), F.explode(tokens(F.col(field))).alias("term")).groupBy("term", "file_id").agg(F.count(F.lit(1)).alias("tf")).select("term", "file_id", F.lit(field).alias("field"), "tf")


def postings_stats(docs: DataFrame, field: str, id_col: str = "file_id") -> DataFrame:
    """term, df, cf: documents with a term and its occurrences."""
    return postings(docs, field, id_col).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("t", lambda x: x == term))


def bm25(docs: DataFrame, field: str, query: str, id_col: str = "file_id") -> DataFrame:
    """file_id, score of the documents that have a term of the query.

    Per document the term counts come from the text itself, so the statistics of the query's few terms are one small
    aggregate and nothing is shuffled by term.
    """
    terms = query_terms(query)
    counted = docs.select(F.col(id_col).alias("file_id"), tokens(F.col(field)).alias("t")).select("file_id", F.size("t").alias("dl"), *[_occurrences(w).alias(f"tf{k}") for k, w in enumerate(terms)])
    if not terms:
        return counted.select("file_id", F.lit(0.0).alias("score")).limit(0)
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    rows = beside(counted.where(" or ".join(f"tf{k} > 0" for k in range(len(terms)))), total)
    score = F.lit(0.0)
    for k in range(len(terms)):
        df, tf = F.col(f"df{k}"), F.col(f"tf{k}")
        idf = F.log(F.lit(1.0) + (F.col("n") - df + F.lit(0.5)) / (df + F.lit(0.5)))
        score = score + idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl")))
    return rows.select("file_id", score.alias("score"))


def text_search(docs: DataFrame, query: str, limit: int = 50, field: str = "content", id_col: str = "file_id", where=None) -> DataFrame:
    """file_id, score, best first, ties by id.  ``where`` filters the hits; corpus statistics stay those of all documents."""
    hits = bm25(docs, field, query, id_col)
    if where is not None:
        hits = hits.join(docs.where(where).select(F.col(id_col).alias("file_id")).distinct(), "file_id", "left_semi")
    return hits.select("file_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(limit)


def weighted_search(docs: DataFrame, query: str, limit: int = 50, name: str = "name", content: str = "content", id_col: str = "file_id") -> DataFrame:
    """file_id, score = 10 x score of the name + 1 x score of the content."""
    parts = bm25(docs, name, query, id_col).withColumn("score", F.col("score") * NAME_WEIGHT).union(bm25(docs, content, query, id_col).withColumn("score", F.col("score") * CONTENT_WEIGHT))
    return parts.groupBy("file_id").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(limit)


def name_matches(files: DataFrame, query: str, limit: int = 50, name: str = "name", id_col: str = "file_id") -> DataFrame:
    """file_id, name of files whose name contains the query in any case, by id; an empty query has no match."""
    if not query.strip():
        return files.select(F.col(id_col).alias("file_id"), F.col(name).alias("name")).limit(0)
    return files.where(contains_ignoring_case(F.col(name), query.strip())).select(F.col(id_col).alias("file_id"), F.col(name).alias("name")).orderBy("file_id").limit(limit)


def indexed_search(index: TextIndex, query: str, file_type: str | None = None, limit: int = 50, language: str | None = None) -> DataFrame:
    """file_id, score, matched as of ``search``, from an index with fields name and content, kinds and trigrams of names.

    The best hits, ``limit`` at most, are known before names are looked at, so names are read only where no text matches.
    """
    hits = index.hits(query, limit, kind=file_type, language=language)
    if hits is not None:
        return hits.withColumn("matched", F.lit("text"))
    return index.names_containing(query, limit, file_type).select("file_id", F.lit(0.0).alias("score"), F.lit("name").alias("matched"))


def search(docs: DataFrame, query: str, file_type: str | None = None, limit: int = 50) -> DataFrame:
    """file_id, score, matched ('text' or 'name') over docs (file_id, name, type, content): names only if no text matches.  For a few
    documents or a single query; ``indexed_search`` doesn't read texts."""
    where = None if file_type is None else F.col("type") == file_type
    text = weighted_search(docs if where is None else docs.where(where), query, limit).withColumn("matched", F.lit("text"))
    fallback = name_matches(docs if where is None else docs.where(where), query, limit).select("file_id", F.lit(0.0).alias("score"), F.lit("name").alias("matched"))
    none = text.agg((F.count(F.lit(1)) == 0).alias("none"))
    return text.union(beside(fallback, none).where("none").drop("none"))


def with_files(hits: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Every replica of each hit (file_id, score), in the hits' order: ``files`` with score and nth, the place of the hit.

    The limit is one on hits, so more rows than that may come.  Hits are a short list, ranked in one small window; up to MOST_NAMED
    of them are found first and looked up by their ids, so ``files`` of nothing else are put together.
    """
    order = (F.desc("score"), F.col("file_id"))
    ranked = hits.select("file_id", "score")
    if limit is not None:
        ranked = ranked.orderBy(*order).limit(limit)
    found = ranked.limit(MOST_NAMED + 1).toArrow()
    if len(found) <= MOST_NAMED:
        ranked = F.broadcast(files.sparkSession.createDataFrame(found, ranked.schema))
        files = files.where(F.col("file_id").isin(found.column("file_id").drop_null().unique().to_pylist()))
    return ranked.withColumn("nth", F.row_number().over(Window.orderBy(*order))).join(files, "file_id").orderBy("nth", "node_id")


def nodes_of(hits: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that hold a hit, each once."""
    return nodes.join(files.join(hits, "file_id", "left_semi"), "node_id", "left_semi")


def fuzzy_names(files: DataFrame, query: str, distance: int = 2, name: str = "name", id_col: str = "file_id") -> DataFrame:
    """file_id, name, distance of names with a word within an edit distance of the query."""
    nearest = F.array_min(F.transform(tokens(F.col(name)), lambda t: F.levenshtein(t, F.lit(query.lower()))))
    return files.select(F.col(id_col).alias("file_id"), F.col(name).alias("name"), nearest.alias("distance")).where(F.col("distance") <= distance)


def in_ranges(files: DataFrame, size: tuple = (None, None), updated: tuple = (None, None), node_id=None) -> DataFrame:
    """Files within a size range, a date range and on a node; open ends are None."""
    out = files
    for column, (low, high) in (("size", size), ("last_updated", updated)):
        out = out if low is None else out.where(F.col(column) >= low)
        out = out if high is None else out.where(F.col(column) <= high)
    return out if node_id is None else out.where(F.col("node_id") == node_id)
