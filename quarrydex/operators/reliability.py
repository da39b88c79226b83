"""Failures and recoveries: MTTR, MTTF, MTBF, availability.

Table: failures (node_id, timestamp, recovery_time, downtime_seconds); recovery_time is null while a node is down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from .ordered import following

DAYS = 30


def intervals(events: DataFrame, failed: Column) -> DataFrame:
    """failures from an event log (node_id, timestamp): a failed event, recovered at the node's next event."""
    rows = following(events, ["node_id"], ["timestamp", "event_id"], "timestamp", "recovery_time").where(failed)
    return rows.select("node_id", "timestamp", "recovery_time", seconds_between(F.col("timestamp"), F.col("recovery_time")).alias("downtime_seconds"))


def record_recovery(failures: DataFrame, recoveries: DataFrame) -> DataFrame:
    """failures with the latest open one of each node closed by its recovery (node_id, timestamp)."""
    nth = F.row_number().over(Window.partitionBy("node_id", F.col("recovery_time").isNull()).orderBy(F.desc("timestamp")))
    marked = failures.withColumn("_open", F.col("recovery_time").isNull() & (nth == 1))
    done = recoveries.groupBy("node_id").agg(F.max("timestamp").alias("_at"))
    closes = F.col("_open") & F.col("_at").isNotNull()
    return marked.join(done, "node_id", "left").withColumns({"downtime_seconds": F.when(closes, seconds_between(F.col("timestamp"), F.col("_at"))).otherwise(F.col("downtime_seconds")), "recovery_time": F.when(closes, F.col("_at")).otherwise(F.col("recovery_time"))}).drop("_open", "_at")


def record_failure(failures: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """failures with ``new`` ones (node_id, timestamp), and nodes in which those that failed are offline, with last_failure."""
    last = new.groupBy("node_id").agg(F.max("timestamp").alias("last_failure"))
    marked = nodes.drop("last_failure").join(last, "node_id", "left").withColumn("status", F.when(F.col("last_failure").isNotNull(), "offline").otherwise(F.col("status")))
    return failures.unionByName(new, allowMissingColumns=True), marked


def open_failures(failures: DataFrame) -> DataFrame:
    """node_id, timestamp of the latest failure of each node that hasn't recovered."""
    return failures.where("recovery_time is null").groupBy("node_id").agg(F.max("timestamp").alias("timestamp"))


def node_metrics(failures: DataFrame, now: Column | None = None, days: int = DAYS) -> DataFrame:
    """node_id, failures, mttr, mttf, mtbf, availability over the recovered failures of the last ``days``.

    MTTF is the mean time from a recovery to the next failure, 0 without such a pair, which makes the availability 0.
    """
    rows = failures.where("recovery_time is not null")
    if now is not None:
        rows = rows.where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))
    gap = seconds_between(F.col("recovery_time"), F.col("next_failure"))
    own = following(rows, ["node_id"], ["timestamp"], "timestamp", "next_failure").withColumn("gap", gap).groupBy("node_id").agg(F.count(F.lit(1)).alias("failures"), F.avg(F.coalesce("downtime_seconds", F.lit(0.0))).alias("r"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("f"))
    return own.select("node_id", "failures", F.round("r", 6).alias("mttr"), F.round("f", 6).alias("mttf"), F.round(F.col("r") + F.col("f"), 6).alias("mtbf"), F.when(F.col("r") + F.col("f") > 0, F.round(F.try_divide("f", F.col("r") + F.col("f")), 6)).otherwise(1.0).alias("availability"))


def system_metrics(failures: DataFrame, nodes: DataFrame, now: Column | None = None, days: int = DAYS) -> DataFrame:
    """nodes, mttr, mtbf, availability over the online nodes; one without failures has availability 1 and no times."""
    own = nodes.where(F.col("status") == "online").select("node_id").join(node_metrics(failures, now, days), "node_id", "left")
    return own.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("mttr"), 6).alias("mttr"), F.round(F.avg("mtbf"), 6).alias("mtbf"), F.round(F.coalesce(F.avg(F.coalesce("availability", F.lit(1.0))), F.lit(1.0)), 6).alias("availability"))
