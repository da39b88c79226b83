"""Streams against their batch twins and hand-computed cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quarrydex.streaming import discovery, elections, heartbeats

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def stream(spark, rows, schema, tmp_path, parts=3):
    folder = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def result(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_outages(spark, tmp_path):
    rows = [("a", at(0)), ("b", at(0)), ("a", at(15)), ("b", at(15.000001)), ("a", at(20)), ("b", at(20)), ("z", at(10_000))]
    batch = heartbeats.outages(spark.createDataFrame(rows, "node_id string, timestamp timestamp"))
    assert [(r.node_id, r.last_seen, r.gap_seconds) for r in batch.collect()] == [("b", at(0), 15.000001)]
    got = result(spark, heartbeats.heartbeat_stream(stream(spark, rows, "node_id string, timestamp timestamp", tmp_path)), "outages", tmp_path)
    assert {(r.node_id, r.event, r["at"]) for r in got} >= {("b", "node_down", at(15)), ("b", "node_up", at(15.000001))}
    assert not [r for r in got if r.node_id == "a" and r["at"] < at(30)]
    assert max(sum(r.node_id == n and r.event == "node_down" for r in got) for n in "az") <= 1


def test_known_senders_and_the_master(spark):
    rows = [("PING", "a", at(0)), ("PONG", "x", at(0)), ("HELLO", "a", at(9)), ("PONG", "b", at(2))]
    messages = spark.createDataFrame(rows, "type string, sender_id string, timestamp timestamp")
    peers = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert {tuple(r) for r in heartbeats.of_peers(messages, peers).collect()} == {("a", at(0)), ("b", at(2))}
    assert [tuple(r)[1:3] for r in heartbeats.replies(messages, "me").collect()] == [("me", "a")]
    events = spark.createDataFrame([("a", "node_down", at(5)), ("b", "node_down", at(5)), ("a", "node_down", at(50)), ("a", "node_up", at(6))], "node_id string, event string, at timestamp")
    terms = spark.createDataFrame([("a", at(0), at(10)), ("b", at(10), None)], "new_master string, since timestamp, until timestamp")
    assert [tuple(r) for r in heartbeats.master_down(events, terms).collect()] == [("a", "master_down", at(5))]


def test_states(spark):
    rows = spark.createDataFrame([("a", at(0)), ("b", at(10))], "node_id string, timestamp timestamp")
    assert {r.node_id: (r.status, r.missed_beats) for r in heartbeats.node_states(rows, F.lit(at(20))).collect()} == {"a": ("offline", 1), "b": ("online", 0)}


def test_discovery(spark, tmp_path):
    good = lambda node, s: json.dumps({"type": "announce", "node_id": node, "ip_address": "10.0.0.1", "port": 1, "timestamp": at(s).isoformat()})
    rows = [(good("a", 0),), (good("a", 90),), ("rubbish",), (good("a", 181),), (json.dumps({"node_id": "x", "port": 0}),), (good("z", 100_000),)]
    want = {("a", at(0), at(90), 2), ("a", at(181), at(181), 1)}
    batch = discovery.sessions(discovery.parse_announcements(spark.createDataFrame(rows, "value string")))
    assert {tuple(r) for r in batch.where("node_id = 'a'").collect()} == want
    raw = stream(spark, rows, "value string", tmp_path)
    got = result(spark, discovery.sessions(discovery.parse_announcements(raw), watermark="90 seconds"), "sessions", tmp_path)
    assert {tuple(r) for r in got if r.node_id == "a"} == want


def test_elections(spark):
    nodes = spark.createDataFrame([("node-1", True, True), ("node-3", False, True), ("node-4", True, True), ("node-10", True, True)], "node_id string, can_be_master boolean, alive boolean")
    assert {r.node_id for r in elections.higher_eligible(nodes, "node-2").collect()} == {"node-4"}
    assert elections.leader(nodes).first().node_id == "node-4"
    assert elections.leader(nodes, numeric=True).first().node_id == "node-10"
    terms = spark.createDataFrame([("a", at(0), 0), ("a", at(1), 0), ("b", at(2), 0)], "new_master string, timestamp timestamp, seq int")
    assert [(r.new_master, r.since, r.until) for r in elections.leader_history(terms).orderBy("since").collect()] == [("a", at(0), at(2)), ("b", at(2), None)]
