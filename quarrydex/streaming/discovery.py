"""Discovery announcements: parsed, then sessions of presence by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import preceding, running_sum

#: A node is gone after three announcements of 30 seconds.
EXPIRY_SECONDS = 90
SCHEMA = "type string, node_id string, ip_address string, port int, timestamp timestamp"


def parse_announcements(raw: DataFrame, own: str | None = None) -> DataFrame:
    """Valid announcements of a column value (JSON), a stream or not; malformed, incomplete and own ones are left out."""
    rows = raw.select(F.from_json(F.col("value").cast("string"), SCHEMA, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    rows = rows.where(F.col("node_id").isNotNull() & F.col("ip_address").isNotNull() & (F.col("port") > 0) & F.col("timestamp").isNotNull())
    return rows if own is None else rows.where(F.col("node_id") != own)


def sessions(announcements: DataFrame, expiry_seconds: int = EXPIRY_SECONDS, watermark: str | None = None) -> DataFrame:
    """node_id, first_seen, last_seen, announcements of each presence; a gap longer than the expiry ends one.

    With a watermark it is a stream, of session windows.  A finished log is read in segments of time: a presence begins where the
    announcement before is too old, the beginnings are counted along the order, and what has the same count is one presence.
    """
    if watermark is not None:
        rows = announcements.withWatermark("timestamp", watermark)
        own = rows.groupBy("node_id", F.session_window("timestamp", f"{expiry_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("announcements"))
        return own.select("node_id", F.col("w.start").alias("first_seen"), (F.col("w.end") - F.make_dt_interval(secs=F.lit(expiry_seconds))).alias("last_seen"), "announcements")
    rows = announcements.select("node_id", "timestamp").where("timestamp is not null").groupBy("node_id", "timestamp").agg(F.count(F.lit(1)).alias("same"))
    rows = preceding(rows, ["node_id"], ["timestamp"], "timestamp", "before")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    begins = F.col("before").isNull() | (micros("timestamp") - micros("before") > expiry_seconds * 1_000_000)
    numbered = running_sum(rows.withColumn("begins", begins.cast("int")), ["node_id"], ["timestamp"], "begins", "nth")
    own = numbered.groupBy("node_id", "nth").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.sum("same").alias("announcements"))
    return own.select("node_id", "first_seen", "last_seen", "announcements")
