"""The hierarchical namespace: paths with their folders, listing, resolving, globs, trees, deletion.

Tables: files (path, file_id), paths (path, parent_path, name, is_file, file_id, depth), aliases (alias, real_path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_path
from ..functions.text import glob


def paths(files: DataFrame) -> DataFrame:
    """Every file and every folder above it: path, parent_path, name, is_file, file_id, depth.

    Of equal paths a file comes before a folder, then the smallest file_id.  The root isn't a row; blank paths are left out.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = files.select(parts.alias("parts"), "file_id").where(F.size("parts") > 0)
    each = rows.select("parts", "file_id", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    up_to = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/"))
    own = each.select(up_to(F.col("depth")).alias("path"), up_to(F.col("depth") - 1).alias("parent_path"), F.element_at("parts", F.col("depth")).alias("name"), F.when(F.col("depth") == F.size("parts"), F.col("file_id")).alias("file_id"), (F.col("depth") == F.size("parts")).alias("is_file"), "depth")
    return own.groupBy("path", "parent_path", "name", "depth").agg(F.max("is_file").alias("is_file"), F.min("file_id").alias("file_id")).select("path", "parent_path", "name", "is_file", "file_id", "depth")


def list_directory(tree: DataFrame, path: str) -> DataFrame:
    """name, is_file, file_id; folders first, then by name."""
    return tree.where(F.col("parent_path") == normal_path(F.lit(path))).select("name", "is_file", "file_id").orderBy("is_file", "name")


def resolve(requests: DataFrame, tree: DataFrame, aliases: DataFrame) -> DataFrame:
    """requested, path, file_id: aliases are followed once, files alone resolve; null where nothing is found."""
    asked = requests.select(F.col("path").alias("requested"), normal_path(F.col("path")).alias("asked"))
    hop = asked.join(aliases.select(F.col("alias").alias("asked"), "real_path"), "asked", "left").withColumn("path", F.coalesce("real_path", "asked"))
    files = tree.where("is_file").select("path", "file_id")
    found = hop.join(files, "path", "left")
    return found.select("requested", F.when(F.col("file_id").isNotNull(), F.col("path")).alias("path"), "file_id")


def create_aliases(aliases: DataFrame, new: DataFrame, tree: DataFrame) -> DataFrame:
    """aliases with the new ones whose target is a file; a new one replaces an old one of its name."""
    fresh = new.select(normal_path(F.col("alias")).alias("alias"), normal_path(F.col("real_path")).alias("real_path"))
    fresh = fresh.join(tree.where("is_file").select(F.col("path").alias("real_path")), "real_path", "left_semi").select("alias", "real_path")
    return aliases.join(fresh.select("alias"), "alias", "left_anti").unionByName(fresh)


def search_glob(tree: DataFrame, pattern: str) -> DataFrame:
    """path, file_id of files whose path matches; * crosses slashes."""
    return tree.where(F.col("is_file") & F.col("path").rlike(glob(pattern))).select("path", "file_id")


def subtree(tree: DataFrame, root: str = "/", depth: int = 3) -> DataFrame:
    """path, depth, is_file, truncated: what is at most ``depth`` levels below the root; folders at that level are truncated."""
    top = "/" + "/".join(p for p in root.split("/") if p)
    level = len([p for p in root.split("/") if p])
    inside = tree if top == "/" else tree.where(F.col("path").startswith(top + "/"))
    below = F.col("depth") - level
    return inside.where(below <= depth).select("path", below.alias("depth"), "is_file", ((below == depth) & ~F.col("is_file")).alias("truncated"))


def deleted_by(tree: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    """The rows that deleting ``path`` takes away: with ``recursive`` what is below too, without it nothing of a folder that isn't empty."""
    top = "/" + "/".join(p for p in path.split("/") if p)
    below = tree.where(F.col("path").startswith(top + "/"))
    own = tree.where(F.col("path") == top)
    if recursive:
        return own.union(below)
    return own.join(below.select(F.lit(top).alias("path")).distinct(), "path", "left_anti")


def delete_path(tree: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    return tree.join(deleted_by(tree, path, recursive).select("path"), "path", "left_anti")


def children(tree: DataFrame) -> DataFrame:
    """path, child_count and child_names of each folder, by name; a folder's own entries are one list, as a directory listing is."""
    return tree.groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("child_count"), F.array_sort(F.collect_list("name")).alias("child_names"))


def add_child(tree: DataFrame, folder: str, name: str, is_file: bool = False) -> DataFrame:
    """tree with an entry below ``folder``, unless it is there already."""
    top = "/" + "/".join(p for p in folder.split("/") if p)
    path = top.rstrip("/") + "/" + name
    new = tree.sparkSession.createDataFrame([(path, top, name, is_file, path.count("/"))], "path string, parent_path string, name string, is_file boolean, depth int")
    return tree.unionByName(new.join(tree.select("path"), "path", "left_anti"), allowMissingColumns=True)


def remove_child(tree: DataFrame, folder: str, name: str) -> DataFrame:
    """tree without an entry below ``folder`` and what is below that."""
    return delete_path(tree, f"{folder}/{name}", recursive=True)


def files_as_folders(tree: DataFrame) -> DataFrame:
    """Files that stand above other paths."""
    return tree.where("is_file").join(tree.select(F.col("parent_path").alias("path")).distinct(), "path", "left_semi")
