"""Checkpoints: snapshots with content digests, verification, restore.

Table: files (node_id, file_id, content_hash, last_updated).  A snapshot is the same rows, written by the caller; its
digests are a row for each node.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from .registry import latest

#: Hexadecimal digits of the file id's MD5 that make a range: a node's files are digested range by range, then the ranges.
RANGE_DIGITS = 3


def entry(of: Callable[[str], Column] = F.col) -> Column:
    stamp = F.coalesce(F.date_format(of("last_updated"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    return F.concat_ws("|", of("file_id").cast("string"), F.coalesce(of("content_hash"), F.lit("")), stamp)


def digest(entries: Column) -> Column:
    """SHA-256 over the sorted entries, joined by commas."""
    return F.sha2(F.array_join(F.sort_array(entries), ",").cast("binary"), 256)


def digests(files: DataFrame, entry_: Column | None = None) -> DataFrame:
    """node_id, files_count, checkpoint_hash: the digest over a node's ranges of their digests.

    A node's files spread over 4,096 ranges, so no task holds more than a range of a node, however many files that has.
    """
    part = F.substring(F.md5(F.col("file_id").cast("string").cast("binary")), 1, RANGE_DIGITS)
    ranges = files.select("node_id", part.alias("part"), (entry() if entry_ is None else entry_).alias("entry")).groupBy("node_id", "part").agg(F.count(F.lit(1)).alias("n"), digest(F.collect_list("entry")).alias("d"))
    # half as many bytes as in hexadecimal digits: with few files in a range this is a row for almost every file
    own = ranges.groupBy("node_id").agg(F.sum("n").alias("files_count"), F.collect_list(F.concat(F.col("part").cast("binary"), F.unhex("d"))).alias("packed"))
    told = F.transform("packed", lambda x: F.concat_ws(":", F.substring(x, 1, RANGE_DIGITS).cast("string"), F.lower(F.hex(F.substring(x, RANGE_DIGITS + 1, 32)))))
    return own.select("node_id", "files_count", digest(told).alias("checkpoint_hash"))


def snapshot(files: DataFrame, now: Column) -> DataFrame:
    """node_id, checkpoint_timestamp, file_id, content_hash, last_updated: what a checkpoint keeps, a row for each file."""
    return files.select("node_id", now.alias("checkpoint_timestamp"), "file_id", "content_hash", "last_updated")


def checkpoint(files: DataFrame, now: Column) -> DataFrame:
    """node_id, timestamp, files_count, checkpoint_hash of the snapshot of the same files."""
    return digests(files).withColumn("timestamp", now)


def coordinated(points: DataFrame) -> DataFrame:
    """nodes, total_files, global_hash over the checkpoints of all nodes, a short line for each."""
    return points.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("files_count"), F.lit(0)).alias("total_files"), digest(F.collect_list(F.concat_ws(":", F.col("node_id").cast("string"), "checkpoint_hash"))).alias("global_hash"))


def verify(points: DataFrame, snapshots: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """node_id, valid: whether a checkpoint's digest is that of its node's snapshot; a node without any files there isn't valid.

    ``keep`` names columns of the checkpoint that go along, so that it isn't made a second time for them.
    """
    again = digests(snapshots).select("node_id", F.col("checkpoint_hash").alias("again"))
    return points.select("node_id", "checkpoint_hash", *keep).join(again, "node_id", "left").select("node_id", F.coalesce(F.col("checkpoint_hash") == F.col("again"), F.lit(False)).alias("valid"), *keep)


def restore(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """files with the rows of the checkpointed nodes replaced by their snapshots."""
    back = snapshots.withColumn("restored_from_checkpoint", F.lit(True))
    return files.join(snapshots.select("node_id").distinct(), "node_id", "left_anti").unionByName(back, allowMissingColumns=True)


#: Digits of the folders of a stored snapshot; a level of the tree for each number of digits up to RANGE_DIGITS.
FOLDER_DIGITS = 2
#: Nodes with ranges that differ, and characters of those ranges' names, that are sent to all tasks; more are dealt out.
MOST_NODES, MOST_NAMES = 1_000_000, 1 << 26
_FILES = "node_id string, files array<struct<prefix:string,file_id:string,content_hash:string,last_updated:timestamp>>, folder string"
_TREE = "node_id string, prefix string, files bigint, digest binary, level int"


def _range(digits: int) -> Column:
    return F.substring(F.md5(F.col("file_id").cast("string").cast("binary")), 1, digits)


def _packed(entries: Column) -> Column:
    return F.unhex(digest(entries))


def _of_ranges(ranges: Column) -> Column:
    """The digest of the range that the given ones, structs of prefix and digest, make up."""
    return _packed(F.transform(ranges, lambda r: F.concat_ws(":", r["prefix"], F.lower(F.hex(r["digest"])))))


def _above(level: DataFrame, digits: int) -> DataFrame:
    """The level of prefixes of so many digits, from the one below."""
    one = F.concat(F.col("prefix").cast("binary"), "digest")  # few bytes to shuffle
    up = level.groupBy("node_id", F.substring("prefix", 1, digits).alias("above")).agg(F.sum("files").alias("files"), F.collect_list(one).alias("packed"))
    ranges = F.transform("packed", lambda x: F.struct(F.substring(x, 1, digits + 1).cast("string").alias("prefix"), F.substring(x, digits + 2, 32).alias("digest")))
    return up.select("node_id", F.col("above").alias("prefix"), "files", _of_ranges(ranges).alias("digest"))


def tree(files: DataFrame, entry_: Column | None = None) -> DataFrame:
    """node_id, prefix, files, digest (bytes): a node's hash tree.  A prefix has its range's digits, the root none; a digest goes over the
    entries of a range, or the digests of the sixteen ranges below."""
    own = files.select("node_id", _range(RANGE_DIGITS).alias("prefix"), (entry() if entry_ is None else entry_).alias("entry"))
    level = own.groupBy("node_id", "prefix").agg(F.count(F.lit(1)).alias("files"), _packed(F.collect_list("entry")).alias("digest"))
    out = level
    for k in reversed(range(RANGE_DIGITS)):
        level = _above(level, k)
        out = out.unionByName(level)
    return out


def store(files: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """Write a snapshot in folders of ranges, and the hash tree of what was written.

    Of several rows of a file on a node the first by ``order`` is kept, if that is given, else all are.  Rows are dealt out once, by folder: there
    they are ranked, and a node's files of a folder (1/256 of them) become one stored row.  So the two lowest levels of the tree, with up to
    a row for each file, are made row by row from what was written; only the digests of folders are dealt out again, for the levels above.
    """
    rows = files.withColumn("folder", _range(FOLDER_DIGITS)).repartition("folder")
    if order:
        rows = latest(rows, ["folder", "file_id", "node_id"], list(order))
    one = F.struct(_range(RANGE_DIGITS).alias("prefix"), F.col("file_id").cast("string").alias("file_id"), F.col("content_hash").cast("string").alias("content_hash"), F.col("last_updated").cast("timestamp").alias("last_updated"))
    kept = rows.groupBy("folder", F.col("node_id").cast("string").alias("node_id")).agg(F.sort_array(F.collect_list(one)).alias("files"))
    kept.select("node_id", "files", "folder").sortWithinPartitions("folder", "node_id").write.partitionBy("folder").parquet(f"{path}/files")
    spark = files.sparkSession
    # of a range the prefix, the number of files and the digest
    of_range = lambda p, own: F.struct(p.alias("prefix"), F.size(own).cast("bigint").alias("files"), _packed(F.transform(own, lambda f: entry(lambda n: f[n]))).alias("digest"))
    prefixes = F.array_distinct(F.transform("files", lambda f: f["prefix"]))
    ranges = F.transform(prefixes, lambda p: of_range(p, F.filter("files", lambda f: f["prefix"].eqNullSafe(p))))
    stored = spark.read.schema(_FILES).parquet(f"{path}/files").select("node_id", "folder", F.size("files").cast("bigint").alias("n"), ranges.alias("ranges"))
    folder = F.struct(F.col("folder").alias("prefix"), F.col("n").alias("files"), _of_ranges(F.col("ranges")).alias("digest"))
    low = stored.select("node_id", F.explode(F.concat("ranges", F.array(folder))).alias("x")).select("node_id", "x.*")
    low.withColumn("level", F.char_length("prefix")).write.partitionBy("level").parquet(f"{path}/tree")
    level, high = spark.read.schema(_TREE).parquet(f"{path}/tree").where(F.col("level") == FOLDER_DIGITS), []
    for k in reversed(range(FOLDER_DIGITS)):
        level = _above(level, k)
        high.append(level.withColumn("level", F.lit(k)))
    functools.reduce(DataFrame.unionByName, high).write.partitionBy("level").mode("append").parquet(f"{path}/tree")


@dataclass
class Ranges:
    """Ranges of nodes: node_id, names (their prefixes, all of as many digits, parted by commas).  ``small`` if tasks can hold all."""

    listed: DataFrame
    digits: int
    small: bool

    @classmethod
    def of(cls, found: DataFrame, digits: int) -> Ranges:
        """Written to the shared folder, so that they are looked for once; ``found`` has node_id and prefix."""
        spark = found.sparkSession
        path = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
        found.groupBy("node_id").agg(F.array_join(F.collect_list("prefix"), ",").alias("names")).write.parquet(path)
        listed = spark.read.schema("node_id string, names string").parquet(path)
        nodes, names = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("names")), F.lit(0))).first()
        return cls(listed, digits, nodes <= MOST_NODES and names <= MOST_NAMES)

    def rows(self) -> DataFrame:
        """node_id, prefix."""
        return self.listed.select("node_id", F.explode(F.split("names", ",")).alias("prefix"))

    def of_those(self, rows: DataFrame) -> DataFrame:
        """The rows, with node_id and prefix, that lie in these ranges; they stay where they are if tasks can hold all ranges."""
        own = F.substring("prefix", 1, self.digits)
        if self.small:
            return rows.join(F.broadcast(self.listed), "node_id").where(F.contains("names", own)).drop("names")
        found = self.rows().withColumnRenamed("prefix", "_above")
        return rows.withColumn("_above", own).join(found, ["node_id", "_above"], "left_semi").drop("_above")


def _differing(left: DataFrame, right: DataFrame) -> Ranges:
    """Ranges whose digests differ between two stored trees, found from the root down.

    A level looks only at the children of ranges that differ above: what is alike costs a row for its node.
    """
    found = None
    for k in range(RANGE_DIGITS + 1):
        a, b = (t.where(F.col("level") == k).select("node_id", "prefix", F.col("digest").alias(n)) for t, n in ((left, "a"), (right, "b")))
        if found is not None:
            a, b = found.of_those(a), found.of_those(b)
        found = Ranges.of(a.join(b, ["node_id", "prefix"], "full").where(~F.col("a").eqNullSafe(F.col("b"))), k)
    return found


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """node_id, prefix: ranges whose digests differ between two stored trees."""
    return _differing(left, right).rows()


def differences(spark, left: str, right: str) -> DataFrame:
    """node_id, file_id, change: what became of files between two stored snapshots: added, removed, changed.

    Only the folders of ranges that differ are read, and of those only such ranges.  Node ids aren't null.
    """
    ranges = _differing(*[spark.read.schema(_TREE).parquet(f"{p}/tree") for p in (left, right)])
    folders = [r[0] for r in ranges.rows().select(F.substring("prefix", 1, FOLDER_DIGITS)).distinct().collect()]  # 256 at most
    sides = []
    for path, name in ((left, "a"), (right, "b")):
        rows = spark.read.schema(_FILES).parquet(f"{path}/files").where(F.col("folder").isin(folders)).select("node_id", F.inline("files"))
        sides.append(ranges.of_those(rows).select("node_id", "file_id", entry().alias(name)))
    both = sides[0].join(sides[1], ["node_id", "file_id"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("node_id", "file_id", change.alias("change")).where("change is not null")
