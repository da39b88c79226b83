"""Files, nodes, mounts and activities: upserts, lookups, sweeps, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import beside


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; ranking starts in each task, so a repeated key is cut down before the shuffle."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; of several new ones the first by ``order`` counts."""
    once = latest(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once, allowMissingColumns=True)


def upsert_contents(old: DataFrame, new: DataFrame) -> DataFrame:
    """contents by file_id; blank new content never replaces what is there."""
    filled = F.trim(F.coalesce("content", F.lit(""))) != ""
    keep = new.where(filled).unionByName(new.where(~filled).join(old.select("file_id"), "file_id", "left_anti"))
    return upsert(old, keep, ["file_id"])


def check_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once; none is right."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def sync_directory(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """file_id, action: add what is new, update what differs in content, delete what is gone."""
    both = stored.select("file_id", F.col("content_hash").alias("old"), F.lit(True).alias("was")).join(scanned.select("file_id", F.col("content_hash").alias("new"), F.lit(True).alias("is")), "file_id", "full")
    action = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update").otherwise("keep")
    return both.select("file_id", action.alias("action"))


def orphan_contents(contents: DataFrame, files: DataFrame) -> DataFrame:
    return contents.join(files.select("file_id"), "file_id", "left_anti")


def delete_node(nodes: DataFrame, files: DataFrame, contents: DataFrame, node_id, with_files: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    left = files.where(F.col("node_id") != node_id) if with_files else files
    return nodes.where(F.col("node_id") != node_id), left, contents.join(left.select("file_id"), "file_id", "left_semi")


def nodes_with_file(files: DataFrame, nodes: DataFrame, file_id) -> DataFrame:
    return nodes.join(files.where(F.col("file_id") == file_id).select("node_id").distinct(), "node_id", "left_semi")


def download_node(files: DataFrame, nodes: DataFrame, file_id, preferred=None) -> DataFrame:
    """node_id: the preferred holder if it is online, else the smallest online one."""
    held = nodes_with_file(files, nodes.where("status = 'online'"), file_id).select("node_id")
    first = [] if preferred is None else [F.when(F.col("node_id") == preferred, 0).otherwise(1)]
    return held.orderBy(*first, "node_id").limit(1)


def register_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with new ones; a known node keeps its stored status.  outcome: registered or updated."""
    was = nodes.select("node_id", F.col("status").alias("_old"))
    fresh = new.join(was, "node_id", "left").withColumn("outcome", F.when(F.col("_old").isNull(), "registered").otherwise("updated")).withColumn("status", F.coalesce("_old", F.lit("online"))).drop("_old")
    return nodes.join(new.select("node_id"), "node_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def timeout_sweep(nodes: DataFrame, now: Column, seconds: int = 300, own=None) -> DataFrame:
    """nodes in which those online but not seen for more than ``seconds`` are offline, the own node left alone."""
    late = (F.col("status") == "online") & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) > seconds * 1_000_000)
    if own is not None:
        late = late & (F.col("node_id") != own)
    return nodes.withColumn("status", F.when(late, "offline").otherwise(F.col("status")))


def recount(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with shared_files_count as it is in ``files``; a node without files has 0."""
    own = files.groupBy("node_id").agg(F.count(F.lit(1)).cast("int").alias("shared_files_count"))
    return nodes.drop("shared_files_count").join(own, "node_id", "left").withColumn("shared_files_count", F.coalesce("shared_files_count", F.lit(0)))


def put_mount(mounts: DataFrame, new: DataFrame) -> DataFrame:
    """mounts with the folders of ``new`` in place of those of the same nodes."""
    return upsert(mounts, new.select("node_id", "folder"), ["node_id"])


def delete_mount(mounts: DataFrame, node_id) -> DataFrame:
    return mounts.where(F.col("node_id") != node_id)


def bulk_outcome(rows: DataFrame, most_bytes: int) -> DataFrame:
    """rows (name, size, content_hash) with status success or error, and error: why a file can't be taken."""
    error = F.when(F.col("name").isNull() | (F.trim("name") == ""), "no name").when(F.col("size") > most_bytes, "too large").when(F.col("content_hash").isNull(), "no content")
    return rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))


def bulk_counts(outcome: DataFrame) -> DataFrame:
    """total, successful, failed."""
    return outcome.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed"))


def with_mounts(nodes: DataFrame, mounts: DataFrame) -> DataFrame:
    return nodes.join(mounts.select("node_id", "folder"), "node_id", "left")


def latest_activities(activities: DataFrame, limit: int = 50, order: list[Column] | None = None) -> DataFrame:
    """The last ``limit`` activities of each user, newest first in nth."""
    own = Window.partitionBy("user_id").orderBy(*(order or [F.desc("timestamp")]))
    return activities.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= limit)


def files_by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("type").agg(F.count(F.lit(1)).alias("files"))


def duplicates(files: DataFrame, key: str = "file_id") -> DataFrame:
    """key, copies of what is there more than once."""
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def index_stats(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """total_files, total_size, duplicate_files, active_nodes, total_nodes."""
    own = files.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("total_size"), F.count_if(F.col("n") > 1).alias("duplicate_files"))
    return beside(total, nodes.agg(F.count_if(F.col("status") == "online").alias("active_nodes"), F.count(F.lit(1)).alias("total_nodes")))


def cluster_health(nodes: DataFrame, system: DataFrame) -> DataFrame:
    """online, offline, healthy, and the columns of ``system`` (one row)."""
    own = nodes.agg(F.count_if(F.col("status") == "online").alias("online"), F.count_if(F.col("status") == "offline").alias("offline"), F.coalesce(F.bool_or(F.col("status") == "online"), F.lit(False)).alias("healthy"))
    return beside(own, system)


def hit_rate(accesses: DataFrame, key: str) -> DataFrame:
    """hits, misses, hit_rate in percent of a cache that forgets nothing: the first access of a key misses; 0 without accesses."""
    own = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("misses"))
    return own.withColumn("hit_rate", F.coalesce(F.round(F.try_divide(F.col("hits") * F.lit(100.0), F.col("hits") + F.col("misses")), 2), F.lit(0.0)))
