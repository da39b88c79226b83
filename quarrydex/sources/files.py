"""Reading directories and stored tables."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.registry import bulk_counts, bulk_outcome

# What a scan leaves out.
EXCLUDED_FOLDERS = [".git", ".svn", "__pycache__", "node_modules", ".venv", "venv", ".env", "dist", "build"]
EXCLUDED_ENDINGS = [".pyc", ".pyo", ".class", ".o", ".obj", ".dll", ".so"]
MOST_BYTES, MOST_TEXT = 100 * 1024 * 1024, 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one for a session on one machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = "file://" + tempfile.mkdtemp(prefix="quarrydex-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a path, as one digest: it changes when a table is written again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    rows = []
    while found.hasNext():
        one = found.next()
        rows.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_directory(spark: SparkSession, folder: str, node_id: str, recursive: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """file_id, node_id, name, path (relative), size, mime_type, type, last_updated, content_hash, content.

    Hidden names, excluded folders and endings and larger files are left out; the size filter reaches the file source.
    content is the text of documents, code and data up to 1 MB.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).where(F.col("length") <= most_bytes)
    root = "/" + "/".join(p for p in folder.split("://")[-1].removeprefix("file:").split("/") if p)
    relative = F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), root + "/", -1)
    parts = F.split("relative", "/")
    rows = found.withColumn("relative", relative).withColumn("name", F.element_at(parts, -1))
    hidden = F.exists(parts, lambda p: p.startswith("."))
    skipped = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(EXCLUDED_FOLDERS))
    rows = rows.where(~hidden & ~skipped & ~S.suffix(F.col("name")).isin(EXCLUDED_ENDINGS))
    kind = S.type_by_extension(F.col("name"))
    content = F.when(kind.isin("document", "code", "data") & (F.col("length") <= MOST_TEXT), S.decoded(F.col("content")))
    rows = rows.withColumn("content_hash", F.sha2("content", 256))
    return rows.select(
        S.scan_id(F.lit(node_id), F.col("relative"), F.col("content_hash")).alias("file_id"),
        F.lit(node_id).alias("node_id"),
        "name",
        F.col("relative").alias("path"),
        F.col("length").alias("size"),
        S.media_type(F.col("name")).alias("mime_type"),
        kind.alias("type"),
        F.col("modificationTime").alias("last_updated"),
        "content_hash",
        content.alias("content"),
    )


def import_folder(spark: SparkSession, folder: str, node_id: str) -> DataFrame:
    """A node's folder without hashes and contents: the scan's columns but for those, file_id from node and relative path."""
    rows = scan_directory(spark, folder, node_id).drop("content", "content_hash")
    return rows.withColumn("file_id", S.import_id(F.lit(node_id), F.col("path")))


def upload(scanned: DataFrame, node_id: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files and contents of what can be taken, with upload ids, and total, successful, failed of all."""
    outcome = bulk_outcome(scanned, most_bytes)
    taken = outcome.where("status = 'success'").withColumn("file_id", S.upload_id(F.lit(node_id), F.col("content_hash"))).withColumn("node_id", F.lit(node_id)).drop("status", "error")
    files, contents = split_ingest(taken)
    return files, contents, bulk_counts(outcome)


def scan_totals(scanned: DataFrame) -> DataFrame:
    """files, bytes, megabytes."""
    own = scanned.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return own.withColumn("megabytes", S.megabytes(F.col("bytes")))


def split_ingest(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and contents (at most 200,000 bytes each) of a scan."""
    return scanned.drop("content"), scanned.where("content is not null").select("file_id", "name", S.truncate_bytes(F.col("content")).alias("content"))


def put_blobs(blobs: DataFrame, path: str) -> None:
    """Write blobs (file_id, data), each id once."""
    blobs.groupBy("file_id").agg(F.max("data").alias("data")).write.mode("overwrite").parquet(path)


def get_blob(spark: SparkSession, path: str, file_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("file_id") == file_id)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """json: each row as a JSON object, times in ISO form."""
    return rows.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))


def parse_peers(peers: Column) -> Column:
    """Peers as id:host:port:heartbeat:election or id:host:port, comma-separated: array of structs; malformed ones are left out."""
    return F.filter(
        F.transform(F.split(peers, ","), lambda p: F.split(F.trim(p), ":")),
        lambda x: F.size(x).isin(3, 5) & F.element_at(x, 3).rlike("^[0-9]+$"),
    )
