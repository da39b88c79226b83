"""Message source, synchronisation and work queue as streams, with restarts, against their batch twins."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quarrydex.functions import scalars as S
from quarrydex.operators import registry, replication
from quarrydex.sources import messages
from quarrydex.sources.buckets import BucketTable
from quarrydex.streaming import heartbeats, sync

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def frames(spark, rows):
    df = spark.createDataFrame(rows, "kind string, sender string, at timestamp")
    return [bytes(r[0]) for r in df.coalesce(1).select(S.frame(F.col("kind"), F.col("sender"), F.create_map(F.lit("k"), F.lit("v")), F.col("at"))).collect()]


def run(query):
    query.awaitTermination(180)
    assert not query.isActive and query.exception() is None


def test_dumps_of_datagrams(spark, tmp_path):
    rows = [("PING", "a", at(0)), ("PONG", "b", at(0)), ("PING", "a", at(15)), ("PONG", "b", at(15.000001)), ("PING", "a", at(20)), ("PONG", "b", at(20)), ("PING", "z", at(10_000))]
    sent = frames(spark, rows)
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate((sent[:2] + [b"", b"junk"], sent[2:5], [b"DSM\x01\x63{}"] + sent[5:])):
        (folder / f"{k}.bin").write_bytes(messages.dump(part))
    (folder / "cut.bin").write_bytes(messages.dump(sent[:1])[:-5])
    (folder / "empty.bin").write_bytes(b"")
    for k, name in enumerate(("0", "1", "cut", "empty", "2")):  # taken up by the time of arrival
        os.utime(folder / f"{name}.bin", (1_700_000_000 + k, 1_700_000_000 + k))
    got = messages.messages(messages.read_dumps(spark, str(folder), stream=False)).cache()
    assert got.where("malformed").count() == 4
    assert sorted((r.type, r.sender_id, r.timestamp) for r in messages.well_formed(got).collect()) == sorted(rows)
    stream = messages.well_formed(messages.messages(messages.read_dumps(spark, str(folder), files=1)))
    down = heartbeats.heartbeat_stream(stream.select(F.col("sender_id").alias("node_id"), "timestamp"))
    run(down.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    batch = heartbeats.outages(messages.well_formed(got).select(F.col("sender_id").alias("node_id"), "timestamp"))
    assert [(r.node_id, r.last_seen) for r in batch.collect()] == [("b", at(0))]
    found = {(r.node_id, r.event, r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found >= {("b", "node_down", at(15)), ("b", "node_up", at(15.000001))} and not [x for x in found if x[0] == "a" and x[2] < at(30)]


REPORTS = "file_id string, node_id string, content_hash string, last_updated timestamp"


@pytest.fixture
def reports(spark, tmp_path):
    parts = [
        [("f1", "n1", "a", at(1)), ("f1", "n2", "b", at(2)), ("f2", "n1", "x", at(1))],
        [("f1", "n1", "c", at(9)), ("f3", "n3", "y", at(1)), ("f2", "n1", "older", at(0))],
        [("f2", "n3", "z", at(5)), ("f1", "n3", "c", at(9))],
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, REPORTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "reports"))
    nodes = spark.createDataFrame([("n1", "online"), ("n2", "online"), ("n3", "online")], "node_id string, status string")
    return parts, nodes


def test_sync_is_the_same_after_a_restart(spark, tmp_path, reports, monkeypatch):
    parts, nodes = reports
    stream = lambda: spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reports"))
    path, out, checkpoint = (str(tmp_path / n) for n in ("files", "plans", "checkpoint"))
    sync.create_files(spark.createDataFrame([], REPORTS), path, 4)
    outdated, calls = replication.outdated, []

    def lost(files, nodes):
        calls.append(1)
        if len(calls) == 2:  # the driver is lost after the table's commit, before the plan is written
            raise RuntimeError("lost")
        return outdated(files, nodes)

    monkeypatch.setattr(replication, "outdated", lost)
    first = sync.run_sync(stream(), path, nodes, out, checkpoint)
    with pytest.raises(Exception):
        first.awaitTermination(180)
    before = BucketTable.open(spark, path).version
    run(sync.run_sync(stream(), path, nodes, out, checkpoint))
    table = BucketTable.open(spark, path)
    assert (before, table.version, table.batch) == (2, 3, 2)  # the batch that was lost isn't taken up twice
    every = [r for p in parts for r in p]
    twin = registry.latest(spark.createDataFrame(every, REPORTS), sync.KEYS, [F.desc("last_updated"), F.desc("content_hash")])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(table.read()) == rows(twin)
    found = rows(spark.read.parquet(f"{out}/batch=2")) if (tmp_path / "plans" / "batch=2").exists() else []
    last = {r[0] for r in parts[2]}
    order = spark.read.parquet(str(tmp_path / "reports"))
    assert order.count() == len(every)
    assert found and set(found) <= set(rows(outdated(table.read(), nodes))) and last


def test_queue_is_the_same_after_a_restart(spark, tmp_path):
    tasks = [[("f1", "n1"), ("f1", "n2")], [("f2", "n3")], [("f3", "n2"), ("f3", "n1")]]
    for rows in tasks:
        spark.createDataFrame(rows, "file_id string, node_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "tasks"))
    nodes = spark.createDataFrame([("n1", "online"), ("n2", "offline"), ("n3", "online")], "node_id string, status string")
    stream = lambda: spark.readStream.schema("file_id string, node_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "tasks"))
    for _ in range(2):  # the second run finds nothing left
        run(sync.run_queue(stream(), nodes, str(tmp_path / "log"), str(tmp_path / "c")))
    every = spark.createDataFrame([t for rows in tasks for t in rows], "file_id string, node_id string")
    key = lambda r: (r.file_id, r.replicated_to, r.failed, r.status)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "log")).collect())) == sorted(map(key, replication.replication_results(every, nodes).collect()))
    sync.queue_batch(every, 0, nodes, str(tmp_path / "again"))
    sync.queue_batch(every, 0, nodes, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == 3
