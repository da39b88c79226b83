"""Leaders: who wins an election, and who led when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import following, preceding


def higher_eligible(nodes: DataFrame, own: str) -> DataFrame:
    """The nodes an election asks: eligible ones with a greater id."""
    return nodes.where(F.col("can_be_master") & (F.col("node_id") > own)).select("node_id")


def leader(nodes: DataFrame, numeric: bool = False) -> DataFrame:
    """node_id of the winner: the greatest id, as a string or by its number, among alive and eligible nodes."""
    key = F.coalesce(F.regexp_extract("node_id", r"(\d+)$", 1).try_cast("bigint"), F.lit(-1)) if numeric else F.col("node_id")
    return nodes.where(F.col("alive") & F.col("can_be_master")).agg(F.max_by("node_id", F.struct(key.alias("k"), F.col("node_id").alias("n"))).alias("node_id"))


def leader_history(messages: DataFrame) -> DataFrame:
    """new_master, since, until from coordinator messages (new_master, timestamp, seq): repeats of the same leader are one term.

    Kept by cluster_id where there is one; without, all messages are one history, in segments of time.
    """
    keep = ["cluster_id"] if "cluster_id" in messages.columns else []
    order = ["timestamp", "seq"]
    starts = preceding(messages, keep, order, "new_master", "before").where(~F.col("new_master").eqNullSafe(F.col("before")))
    return following(starts, keep, order, "timestamp", "until").select(*keep, "new_master", F.col("timestamp").alias("since"), "until")
