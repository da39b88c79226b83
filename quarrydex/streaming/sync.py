"""Synchronisation and replication as running jobs: micro-batches whose effects are the same if one is done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import replication
from ..sources.buckets import BucketTable

KEYS = ["file_id", "node_id"]
#: What is done next, by default: all that is there, then the query ends.  ``{"processingTime": "60 seconds"}`` keeps it running.
ONCE = {"availableNow": True}


def sync_batch(batch: DataFrame, number: int, path: str, nodes: DataFrame, out: str) -> None:
    """Take up reported replicas (file_id, node_id, content_hash, last_updated) and write what has to be copied.

    The table of files under ``path`` keeps the latest report of each replica and notes the batch's number in its manifest, so a
    batch that comes again changes nothing.  The plan is that of the reported files alone, written over an earlier try.
    """
    order = [F.desc("last_updated"), F.desc("content_hash")]
    table = BucketTable.open(batch.sparkSession, path).upsert(batch, order, stored_too=True, batch=number)
    files = table.lookup(batch.select("file_id"))
    replication.outdated(files, nodes).write.mode("overwrite").parquet(f"{out}/batch={number}")


def create_files(files: DataFrame, path: str, buckets: int = 64) -> BucketTable:
    """The table that ``sync_batch`` keeps: one row a replica, all replicas of a file in one bucket."""
    return BucketTable.create(files, path, KEYS, buckets, by=["file_id"])


def run_sync(reports: DataFrame, path: str, nodes: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A query that keeps the files under ``path`` in step with a stream of reports; plans are in ``out``, a folder for each batch."""
    step = lambda batch, number: sync_batch(batch, number, path, nodes, out)
    return reports.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def queue_batch(batch: DataFrame, number: int, nodes: DataFrame, log: str) -> None:
    """Work off tasks (file_id, node_id: a target each): the rows of the replication log, written over an earlier try."""
    replication.replication_results(batch, nodes).write.mode("overwrite").parquet(f"{log}/batch={number}")


def run_queue(tasks: DataFrame, nodes: DataFrame, log: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A query that works off a stream of replication tasks; a task's targets come in one file.  ``log`` has a folder for each batch."""
    step = lambda batch, number: queue_batch(batch, number, nodes, log)
    return tasks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()
