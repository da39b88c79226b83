"""Heartbeats: outages as a stream with event-time timers, and the same from a finished log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import following, latest

TIMEOUT_SECONDS = 15
OUT = "node_id string, event string, at timestamp"


def heartbeat_stream(messages: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """node_id, event, at: one node_down for each outage, ``timeout_seconds`` after the last message, and one node_up at its end.

    ``messages`` (node_id, timestamp) is a stream; a gap of exactly the timeout isn't an outage.  The watermark is the
    timeout; the state of a node is two values, held until the next message.
    """
    limit = timeout_seconds * 1_000_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, down = state.get if state.exists else (None, False)
        out: list[tuple] = []
        if state.hasTimedOut:
            if not down:
                out.append(("node_down", last + limit))
            state.update((last, True))
        else:
            for at in sorted(int(t.value // 1000) for b in batches for t in b["timestamp"]):
                if last is not None and at - last > limit:
                    if not down:
                        out.append(("node_down", last + limit))
                    down = True
                if down and (last is None or at > last):
                    out.append(("node_up", at))
                    down = False
                last = at if last is None else max(last, at)
            due = (last + limit) // 1000 + 1
            if not down and due <= state.getCurrentWatermarkMs():
                out.append(("node_down", last + limit))
                down = True
            state.update((last, down))
            if not down:
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"node_id": [key[0]] * len(out), "event": [e for e, _ in out], "at": pd.to_datetime([t for _, t in out], unit="us")})

    return messages.withWatermark("timestamp", f"{timeout_seconds} seconds").groupBy("node_id").applyInPandasWithState(update, OUT, "last bigint, down boolean", "append", GroupStateTimeout.EventTimeTimeout)


def of_peers(messages: DataFrame, peers: DataFrame) -> DataFrame:
    """Pings and pongs (type, sender_id, timestamp) of known peers (node_id), as node_id, timestamp; others are ignored.  ``messages`` may be a stream."""
    rows = messages.where(F.col("type").isin("PING", "PONG")).select(F.col("sender_id").alias("node_id"), "timestamp")
    return rows.join(peers.select("node_id").distinct(), "node_id", "left_semi")


def replies(messages: DataFrame, own) -> DataFrame:
    """The pong that each ping gets, known sender or not: type, sender_id, in_reply_to, timestamp."""
    return messages.where(F.col("type") == "PING").select(F.lit("PONG").alias("type"), F.lit(own).alias("sender_id"), F.col("sender_id").alias("in_reply_to"), "timestamp")


def master_down(events: DataFrame, terms: DataFrame) -> DataFrame:
    """Of node_down events (node_id, event, at) those of the node that led then; terms: new_master, since, until (null: still).

    Terms follow one another, so an event belongs to the last one that began by then: both go along one order of time, cut into
    segments, and each event takes the last term that passed.
    """
    led = terms.select(F.col("since").cast(events.schema["at"].dataType).alias("at"), F.lit(0).alias("turn"), F.struct("new_master", "until").alias("term"), F.coalesce(F.col("until").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")).alias("end"), F.lit(None).cast(events.schema["node_id"].dataType).alias("node_id"))
    down = events.where("event = 'node_down'").select("at", F.lit(1).alias("turn"), F.lit(None).cast(led.schema["term"].dataType).alias("term"), F.col("at").cast("timestamp").alias("end"), "node_id")
    both = latest(led.unionByName(down), [], ["at", "turn", "end"], "term", "now").where("turn = 1")
    hit = both.where((F.col("now.new_master") == F.col("node_id")) & (F.col("now.until").isNull() | (F.col("at") < F.col("now.until"))))
    return hit.select("node_id", F.lit("master_down").alias("event"), "at").distinct()


def outages(messages: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """node_id, last_seen, back_at, gap_seconds of every gap longer than the timeout in a finished log (node_id, timestamp)."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = following(messages, ["node_id"], ["timestamp"], "timestamp", "back_at").where(F.col("back_at").isNotNull())
    gap = micros("back_at") - micros("timestamp")
    return rows.where(gap > timeout_seconds * 1_000_000).select("node_id", F.col("timestamp").alias("last_seen"), "back_at", (gap / F.lit(1e6)).alias("gap_seconds"))


def node_states(messages: DataFrame, now, timeout_seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """node_id, last_seen, status, missed_beats as of ``now``; status is online, or offline after more than the timeout."""
    last = messages.groupBy("node_id").agg(F.max("timestamp").alias("last_seen"))
    silent = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / F.lit(1e6)
    return last.withColumn("status", F.when(silent > timeout_seconds, "offline").otherwise("online")).withColumn("missed_beats", F.floor(silent / timeout_seconds))
