"""Segmented scans against windows over whole groups, with one group that has nearly all rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrydex.operators import ordered, reliability, routing
from quarrydex.streaming import discovery, elections, heartbeats

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        node = None if rng.random() < 0.02 else "" if rng.random() < 0.02 else "hot" if rng.random() < 0.9 else f"n{rng.randrange(5)}"
        rows.append((i, node, START + timedelta(seconds=rng.randrange(40 * 86_400) // 7 * 7), rng.choice([1, -1, -1, 1]), rng.choice([None, None, i])))
    return spark.createDataFrame(rows, "event_id bigint, node_id string, timestamp timestamp, delta int, value bigint").repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("by", [["node_id"], []])
@pytest.mark.parametrize("segment", [3600, 86_400, 10**9])
def test_scans_equal_windows(events, by, segment):
    order = ["timestamp", "event_id"]
    w = Window.partitionBy(*by).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert rows_of(ordered.following(events, by, order, "event_id", "x", segment)) == rows_of(events.withColumn("x", F.lead("event_id").over(w)))
    assert rows_of(ordered.preceding(events, by, order, "value", "x", segment)) == rows_of(events.withColumn("x", F.lag("value").over(w)))
    assert rows_of(ordered.latest(events, by, order, "value", "x", segment)) == rows_of(events.withColumn("x", F.last("value", True).over(up_to)))
    total = events.withColumn("x", F.sum("delta").over(up_to))
    assert rows_of(ordered.running_sum(events, by, order, "delta", "x", segment=segment)) == rows_of(total)
    floored = total.withColumn("x", F.col("x") - F.least(F.lit(0), F.min("x").over(up_to)))
    assert rows_of(ordered.running_sum(events, by, order, "delta", "x", 0, segment)) == rows_of(floored)


def test_numbers_as_order_and_no_rows(spark, events):
    numbered = events.withColumn("at", F.col("event_id") % 100).drop("timestamp")
    w = Window.partitionBy("node_id").orderBy("at", "event_id")
    assert rows_of(ordered.following(numbered, ["node_id"], ["at", "event_id"], "event_id", "x", 7)) == rows_of(numbered.withColumn("x", F.lead("event_id").over(w)))
    for f in (ordered.following, ordered.preceding, ordered.latest, ordered.running_sum):
        assert f(events.limit(0), ["node_id"], ["timestamp"], "delta", "x").collect() == []


def test_a_hot_node_is_many_parts(events):
    own = ordered._cut(events.where("node_id = 'hot'"), ["node_id"], ["timestamp"], ordered.SEGMENT).groupBy("_key", "_segment").count()
    sizes = sorted(r["count"] for r in own.collect())
    assert len(sizes) == 40 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_what_is_built_on_them(events):
    w = Window.partitionBy("node_id").orderBy("timestamp", "event_id")
    counted = routing.active_queries(events.select("event_id", "node_id", "timestamp", "delta"), ["timestamp", "event_id"]).select("event_id", "active_queries")
    held, want = {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.timestamp, r.event_id)):
        held[r.node_id] = want[r.event_id] = max(0, held.get(r.node_id, 0) + r.delta)
    assert dict(map(tuple, counted.collect())) == want
    failures = reliability.intervals(events, F.col("delta") == -1)
    assert rows_of(failures.select("node_id", "timestamp", "recovery_time")) == rows_of(events.withColumn("r", F.lead("timestamp").over(w)).where("delta = -1").select("node_id", "timestamp", "r"))


def test_sessions_equal_session_windows(spark, events):
    rows = events.select("node_id", "timestamp")
    edge = spark.createDataFrame([("e", START + timedelta(seconds=s)) for s in (0, 90, 180, 271, 271)], "node_id string, timestamp timestamp")
    own = rows.union(edge)
    w = own.groupBy("node_id", F.session_window("timestamp", "90 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    want = w.select("node_id", F.col("w.start"), (F.col("w.end") - F.expr("interval 90 seconds")), "n")
    assert rows_of(discovery.sessions(own)) == rows_of(want)


def test_leaders_as_of(spark):
    at = lambda s: START + timedelta(seconds=s)
    rng = random.Random(9)
    seconds = sorted(rng.sample(range(10 * 86_400), 300))
    messages = spark.createDataFrame([(rng.choice("abc"), at(s), i) for i, s in enumerate(seconds)], "new_master string, timestamp timestamp, seq int")
    terms = elections.leader_history(messages).collect()
    assert [t.since for t in sorted(terms, key=lambda t: t.since)][1:] == sorted(t.until for t in terms if t.until)
    events = [(rng.choice("abc"), "node_down", at(rng.choice(seconds) + rng.choice([0, 0, 1, 77]))) for _ in range(500)] + [("a", "node_up", at(5)), ("a", "node_down", at(-1))]
    want = {(n, "master_down", t) for n, e, t in events if e == "node_down" for x in terms if x.new_master == n and x.since.replace(tzinfo=None) <= t.replace(tzinfo=None) and (x.until is None or t.replace(tzinfo=None) < x.until)}
    got = heartbeats.master_down(spark.createDataFrame(events, "node_id string, event string, at timestamp"), spark.createDataFrame(terms, "new_master string, since timestamp, until timestamp"))
    assert {(r.node_id, r.event, r.at.replace(tzinfo=timezone.utc)) for r in got.collect()} == want
