"""Choosing nodes: load scores, four strategies for queries, placement of documents.

Tables: nodes (node_id, status), loads (node_id, active_queries, cpu_usage, memory_usage, document_count, last_updated),
scores (node_id, score).  Missing scores count as 0.5 and missing loads as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import beside
from .ordered import running_sum

STRATEGIES = ("round_robin", "least_connections", "semantic", "weighted")


def load_score(queries: Column, cpu: Column, memory: Column) -> Column:
    """0.3 x queries (10 are full) + 0.4 x processor + 0.3 x memory, 0 to 1."""
    return F.lit(0.3) * F.least(queries / F.lit(10.0), F.lit(1.0)) + F.lit(0.4) * cpu / F.lit(100.0) + F.lit(0.3) * memory / F.lit(100.0)


def available(nodes: DataFrame, exclude: list | None = None) -> DataFrame:
    rows = nodes.where(F.col("status") == "online")
    return rows.where(~F.col("node_id").isin(list(exclude))) if exclude else rows


def with_loads(nodes: DataFrame, loads: DataFrame) -> DataFrame:
    held = nodes.join(loads, "node_id", "left")
    return held.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("active_queries", "cpu_usage", "memory_usage", "document_count")}).withColumn("load", load_score(F.col("active_queries"), F.col("cpu_usage"), F.col("memory_usage")))


def select_nodes(nodes: DataFrame, loads: DataFrame, scores: DataFrame | None = None, strategy: str = "weighted", k: int = 3, exclude: list | None = None, now: Column | None = None, stale_seconds: int = 30, cursor: int = 0) -> DataFrame:
    """node_id, score, best first.  Without scores semantic and weighted fall back on least connections.

    With no more nodes than asked for, all of them come, ordered the same way.  A load older than ``stale_seconds`` counts as 0.5.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    rows = with_loads(available(nodes, exclude).select("node_id"), loads)
    if strategy == "round_robin":
        # a few nodes: one small window over them
        every = Window.orderBy("node_id")
        turn = F.pmod(F.row_number().over(every) - F.lit(2 + cursor), F.count(F.lit(1)).over(Window.partitionBy()))
        return rows.select("node_id", (-turn).cast("double").alias("score")).orderBy(F.desc("score")).limit(k)
    if strategy == "least_connections" or scores is None:
        return rows.select("node_id", (-F.col("active_queries")).cast("double").alias("score")).orderBy(F.desc("score"), "node_id").limit(k)
    if strategy == "semantic":
        return rows.join(scores.select("node_id", "score"), "node_id").select("node_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)
    free = F.lit(1.0) - F.col("load")
    if now is not None:
        free = F.when(F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_updated").cast("timestamp")) > stale_seconds * 1_000_000, F.lit(False)), 0.5).otherwise(free)
    both = rows.join(scores.select("node_id", F.col("score").alias("own")), "node_id", "left")
    return both.select("node_id", F.round(F.lit(0.6) * F.coalesce("own", F.lit(0.5)) + F.lit(0.4) * free, 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def placement_scores(nodes: DataFrame, loads: DataFrame, scores: DataFrame | None = None, exclude: list | None = None) -> DataFrame:
    """node_id, score: 0.4 x affinity + 0.4 x (1 - load) + 0.2 x (1 - documents / most documents)."""
    rows = with_loads(available(nodes, exclude).select("node_id"), loads)
    most = loads.agg(F.greatest(F.coalesce(F.max("document_count"), F.lit(0)), F.lit(1)).alias("most"))  # one row
    rows = beside(rows, most)
    rows = rows.withColumn("own", F.lit(0.5)) if scores is None else rows.join(scores.select("node_id", F.col("score").alias("own")), "node_id", "left")
    score = F.lit(0.4) * F.coalesce("own", F.lit(0.5)) + F.lit(0.4) * (F.lit(1.0) - F.col("load")) + F.lit(0.2) * (F.lit(1.0) - F.col("document_count") / F.col("most"))
    return rows.select("node_id", F.round(score, 6).alias("score"))


def place_document(nodes: DataFrame, loads: DataFrame, scores: DataFrame | None = None, exclude: list | None = None) -> DataFrame:
    """The one best node; no row if none is online."""
    return placement_scores(nodes, loads, scores, exclude).orderBy(F.desc("score"), "node_id").limit(1)


def load_totals(loads: DataFrame) -> DataFrame:
    """nodes, mean_load, active_queries."""
    own = load_score(F.col("active_queries"), F.col("cpu_usage"), F.col("memory_usage"))
    return loads.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.coalesce(F.avg(own), F.lit(0.0)), 6).alias("mean_load"), F.coalesce(F.sum("active_queries"), F.lit(0)).alias("active_queries"))


def latest_loads(events: DataFrame) -> DataFrame:
    """Loads from partial updates (node_id, timestamp, and any of the figures): the last value that was given of each."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("timestamp"))).alias(c)
    return events.groupBy("node_id").agg(*[last(c) for c in ("active_queries", "cpu_usage", "memory_usage", "document_count")], F.max("timestamp").alias("last_updated"))


def active_queries(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """events (node_id, timestamp, delta of +1 or -1) with active_queries after each: a running count that never falls below 0.

    It is put together from segments of a day, so a node that has all events is many tasks.
    """
    return running_sum(events, ["node_id"], order or ["timestamp"], "delta", "active_queries", 0)


def merge_results(parts: DataFrame, k: int = 10, dedup: str = "first") -> DataFrame:
    """file_id, node_id, score from partial results (node_order, file_id, node_id, score): each file once, best k."""
    order = [F.col("node_order"), F.desc("score")] if dedup == "first" else [F.desc("score"), F.col("node_order")]
    once = parts.withColumn("seen", F.row_number().over(Window.partitionBy("file_id").orderBy(*order, "node_id"))).where("seen = 1")
    return once.select("file_id", "node_id", "score").orderBy(F.desc("score"), "file_id").limit(k)


def query_stats(log: DataFrame) -> DataFrame:
    """queries, mean_latency_ms (0 when there is none) over a log (latency_ms)."""
    return log.agg(F.count(F.lit(1)).alias("queries"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("mean_latency_ms"))
