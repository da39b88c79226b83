"""Replicas: versions, conflicts, canonical versions, placement, coverage.

Tables: files (file_id, node_id, content_hash, last_updated), nodes (node_id, status).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from ..functions.md5 import by_length, first_words, first_words_of_pairs
from ..functions.tables import beside

REPLICATION_FACTOR = 2
#: Node ids of one row, about, and nodes that ``rendezvous`` ranks at once; scores of files and children at once, about, as their columns stay in the cache.
BLOCK, MOST_HELD, MOST_SCORES = 10_000, 1_000_000, 1 << 16
#: Turns beyond the nodes asked for in which a file looks for a node that it hasn't got.
TURNS = 6
#: Nodes beyond those asked for whose hashes are expected below the bound of the first look.
SPARE = 40


def versions(files: DataFrame) -> DataFrame:
    """file_id, versions: array of (node_id, last_updated, content_hash) by node."""
    return files.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "last_updated", "content_hash"))).alias("versions"))


def _told(h: str = "content_hash") -> Column:
    return F.when(F.col(h) != "", F.col(h))


def conflicts(files: DataFrame) -> DataFrame:
    """file_id, hashes, holders of files with more than one content; null and empty hashes don't count.

    Least and greatest hash differ exactly then, so no sets are built.
    """
    own = files.groupBy("file_id").agg(F.min(_told()).alias("low"), F.max(_told()).alias("high"), F.count(F.lit(1)).alias("holders"))
    return own.where("low <> high").select("file_id", "holders")


def canonical(files: DataFrame, strategy: str = "last_write_wins") -> DataFrame:
    """file_id, node_id, content_hash, last_updated of the version that counts: the last (or first) written, ties to the smallest node.

    ``max_by`` combines within each task; a file on very many nodes is no burden.
    """
    time = F.coalesce(F.unix_micros(F.col("last_updated").cast("timestamp")), F.lit(-(1 << 62)))
    row = F.struct("node_id", "content_hash", "last_updated")
    if strategy == "last_write_wins":
        best = F.min_by(row, F.struct((-time).alias("t"), F.col("node_id")))
    elif strategy == "first_write_wins":
        best = F.min_by(row, F.struct(time.alias("t"), F.col("node_id")))
    else:
        raise ValueError("strategy must be last_write_wins or first_write_wins")
    return files.groupBy("file_id").agg(best.alias("x")).select("file_id", "x.*")


def outdated(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_id, node_id, source_node, canonical_hash: replicas on online nodes whose content isn't the canonical one."""
    best = canonical(files).join(conflicts(files).select("file_id"), "file_id", "left_semi").select("file_id", F.col("node_id").alias("source_node"), F.col("content_hash").alias("canonical_hash"))
    online = nodes.where(F.col("status") == "online").select("node_id")
    return files.join(best, "file_id").where(~F.col("content_hash").eqNullSafe(F.col("canonical_hash"))).join(online, "node_id", "left_semi").select("file_id", "node_id", "source_node", "canonical_hash")


def synchronise(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files_checked, conflicts, updates."""
    return beside(files.agg(F.count_distinct("file_id").alias("files_checked")), conflicts(files).agg(F.count(F.lit(1)).alias("conflicts")), outdated(files, nodes).agg(F.count(F.lit(1)).alias("updates")))


def copies(files: DataFrame) -> DataFrame:
    return files.groupBy("file_id").agg(F.count(F.lit(1)).alias("copies"))


def replication_status(files: DataFrame, factor: int = REPLICATION_FACTOR) -> DataFrame:
    """unique_files, total_replicas, fully_replicated, under_replicated, coverage_percent, over distinct files; 0 % of none."""
    own = copies(files).agg(F.count(F.lit(1)).alias("unique_files"), F.coalesce(F.sum("copies"), F.lit(0)).alias("total_replicas"), F.count_if(F.col("copies") >= factor).alias("fully_replicated"))
    return own.withColumn("under_replicated", F.col("unique_files") - F.col("fully_replicated")).withColumn("coverage_percent", F.coalesce(F.round(F.try_divide(F.col("fully_replicated") * F.lit(100.0), F.col("unique_files")), 6), F.lit(0.0)))


def under_replicated(files: DataFrame, nodes: DataFrame, factor: int = REPLICATION_FACTOR) -> DataFrame:
    """file_id, holders, missing: files with fewer online holders than asked for; repeated rows of a file and node count once.

    Up to two copies the least and the greatest online holder tell none, one and more apart, so no sets are built.
    """
    if factor <= 2:
        online = nodes.where(F.col("status") == "online").groupBy("node_id").agg(F.count(F.lit(1)).alias("up"))
        up = F.when(F.col("up").isNotNull(), F.col("node_id"))
        own = files.join(online, "node_id", "left").groupBy("file_id").agg(F.min(up).alias("low"), F.max(up).alias("high"), F.coalesce(F.max("up"), F.lit(0)).alias("holders"))
        own = own.where("low is null or low = high").select("file_id", "holders")
    else:
        online = nodes.where(F.col("status") == "online").select("node_id", F.lit(1).alias("up"))
        own = files.select("file_id", "node_id").distinct().join(online, "node_id", "left").groupBy("file_id").agg(F.count("up").alias("holders"))
    return own.where(F.col("holders") < factor).withColumn("missing", F.lit(factor) - F.col("holders"))


@dataclass
class Nodes:
    """The online nodes that a task ranks: their ids, those as text, and the places and bytes of the texts of each length."""

    ids: pa.Array
    names: list[bytes]
    sizes: list[tuple[np.ndarray, np.ndarray]]


def _beside_nodes(rows: DataFrame, nodes: DataFrame, held: int | None = None) -> DataFrame:
    """``rows`` dealt out by hash, and all online nodes before those of each part, in rows of BLOCK ids and beyond ``held`` in groups that
    every row meets one by one: columns _part, _group, _nodes and those of ``rows``.

    Parts are by number, so that few bytes don't become one task: the work is in the hashes.
    """
    online = nodes.where((F.col("status") == "online") & F.col("node_id").isNotNull()).select("node_id").distinct()
    count = online.count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-count // held)) if held else 1
    number = F.pmod(F.xxhash64("node_id"), F.lit(max(groups, -(-count // BLOCK))))
    listed = online.groupBy(number.alias("_number")).agg(F.collect_list(F.struct("node_id", F.col("node_id").cast("string").cast("binary").alias("name"))).alias("_nodes"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    listed = listed.select(each(parts).alias("_part"), F.pmod("_number", F.lit(groups)).cast("int").alias("_group"), "_nodes")
    dealt = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int").alias("_part"), each(groups).alias("_group"), *rows.columns)
    both = dealt.unionByName(listed, allowMissingColumns=True)
    return both.repartition(parts, "_part").sortWithinPartitions("_part", "_group", F.col("_nodes").isNull())


def _with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Nodes, pa.RecordBatch]]:
    """The rows of each part and group, batch by batch, with its nodes."""
    key, held, nodes = None, [], None
    for batch in batches:
        is_nodes = batch.column("_nodes").is_valid().to_pylist()
        keys = list(zip(batch.column("_part").to_pylist(), batch.column("_group").to_pylist(), is_nodes))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            own = batch.slice(start, i - start)
            if keys[start][:2] != key:
                key, held, nodes = keys[start][:2], [], None
            if keys[start][2]:
                held.append(own.column("_nodes").flatten())
            elif held:
                if nodes is None:
                    all_ = pa.concat_arrays(held)
                    names = all_.field("name").to_pylist()
                    nodes = Nodes(all_.field("node_id"), names, by_length(names))
                yield nodes, own
            start = i


def _ranked(nodes: Nodes, head: bytes | None, among) -> list[int]:
    """Places of nodes by the MD5 of file:node, then by id; a file without an id has no hash."""
    ids = nodes.ids.take(pa.array(among, pa.int64())).to_pylist()
    digests = [b"" if head is None else hashlib.md5(head + nodes.names[k]).digest() for k in among]
    return [k for _, _, k in sorted(zip(digests, ids, among))]


def _least(nodes: Nodes, heads: list[bytes | None], bound: int) -> list[np.ndarray]:
    """For each head the places of the nodes whose hash begins below ``bound``; all of them for a head that is None."""
    every = np.arange(len(nodes.names))
    told = [k for k, h in enumerate(heads) if h is not None]
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for which, texts in by_length([heads[k] for k in told]):
        for index, names in nodes.sizes:
            for a, b, numbers in first_words(texts, names):
                r, c = np.nonzero(numbers < bound)
                rows.append(which[a + r])
                places.append(index[b + c])
    row, place = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(row, kind="stable")
    found = np.split(place[order], np.searchsorted(row[order], np.arange(1, len(told))))
    out = [every] * len(heads)
    for k, own in zip(told, found):
        out[k] = own
    return out


def rendezvous(files: DataFrame, nodes: DataFrame, factor: int = REPLICATION_FACTOR, source: str | None = None, exclude: str | None = None, wanted: str | None = None) -> DataFrame:
    """file_id, node_id, nth: the online nodes with the least md5 of file:node, for each row of ``files``; equal rows count once.

    Left out are the node in column ``source`` and those in the array column ``exclude``; the column ``wanted`` says how
    many a file gets where that isn't ``factor``.  A file with several sources is placed for each of them, on distinct nodes.
    Every file meets every node: a task holds the nodes and hashes a file with all of them by whole columns.  The hashes
    are spread evenly, so whole digests are made only of those below a bound that about SPARE more nodes pass than asked for; a row with
    too few of them looks at all.  ``placed`` is for clusters where files times nodes is too much.
    """
    kind = nodes.schema["node_id"].dataType
    columns = [F.col("file_id"), *([F.col(source).cast(kind).alias("_source")] if source else []), *([F.col(exclude).cast(ArrayType(kind)).alias("_held")] if exclude else []), *([F.col(wanted).cast("int").alias("_wanted")] if wanted else [])]
    rows = files.select(*columns).distinct()
    names, spare = rows.columns, SPARE
    out = StructType([*rows.schema, StructField("_near", ArrayType(StructType([StructField("h", BinaryType()), StructField("node_id", kind)])))])
    arrow = to_arrow_schema(out)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, batch in _with_nodes(batches):
            heads = batch.column("_head").to_pylist()
            many = [max(0, n or 0) for n in batch.column("_wanted").to_pylist()] if wanted else [factor] * len(batch)
            left = [set() for _ in heads]
            for column in ("_source", "_held"):
                if column in names:
                    for gone, value in zip(left, batch.column(column).to_pylist()):
                        gone.update(value or [] if column == "_held" else [value])
            bound = min(1 << 32, (max(many) + spare) * (1 << 32) // max(len(own.names), 1))
            near, number = [], {n: k for k, n in enumerate(own.ids.to_pylist())} if source or exclude else {}
            for head, n, gone, places in zip(heads, many, left, _least(own, heads, bound)):
                gone = {number[g] for g in gone if g in number}
                places = [k for k in places.tolist() if k not in gone]
                if len(places) < n and bound < 1 << 32:
                    places = [k for k in range(len(own.names)) if k not in gone]
                near.append(_ranked(own, head, places)[:n])
            flat = [k for ks in near for k in ks]
            digests = [None if h is None else hashlib.md5(h + own.names[k]).digest() for h, ks in zip(heads, near) for k in ks]
            taken = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), own.ids.take(pa.array(flat, pa.int64()))], names=["h", "node_id"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(ks) for ks in near])]), pa.int32()), taken)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], [*names, "_near"]).cast(arrow)

    head = F.concat(F.col("file_id").cast("string"), F.lit(":")).cast("binary")
    near = _beside_nodes(rows.withColumn("_head", head), nodes, MOST_HELD).mapInArrow(rank, out)
    many = F.lit(factor) if wanted is None else F.col("_wanted")
    near = near.groupBy(*names).agg(F.flatten(F.collect_list("_near")).alias("_near"))
    chosen = near.select("file_id", F.posexplode(F.slice(F.array_sort("_near"), F.lit(1), many)).alias("nth", "x"))
    return chosen.select("file_id", "x.node_id", (F.col("nth") + 1).alias("nth"))


@dataclass
class Children:
    """The children of a level of the tree whose texts are equally long, by parent and in order: where each parent's begin and how
    many they are, their numbers on the next level (places, on the last one), weights and ranks."""

    texts: np.ndarray
    start: np.ndarray
    many: np.ndarray
    number: np.ndarray
    weight: np.ndarray
    rank: np.ndarray


def _children(texts: list[bytes], parent: np.ndarray, number: np.ndarray, weight: np.ndarray) -> list[Children]:
    """Of texts in the order of their parents and their own."""
    edges, out = np.arange(parent.max(initial=-1) + 2), []
    for rank, matrix in by_length(texts):
        start = np.searchsorted(parent[rank], edges)
        out.append(Children(matrix, start[:-1], np.diff(start), number[rank], weight[rank], rank))
    return out


def _tree(nodes: Nodes, depth: int) -> list[list[Children]]:
    """The levels of the tree.

    A node's way down is its hash's first ``depth`` hexadecimal digits, the last level has the nodes themselves, by place.  A weight is the
    number of nodes below.  No parent has more than sixteen children but those of the last level.
    """
    ways = np.frombuffer("".join([hashlib.md5(n).hexdigest()[:depth] for n in nodes.names]).encode(), np.uint8).reshape(len(nodes.names), depth)
    parent, levels = np.zeros(len(ways), np.int64), []
    for k in range(1, depth + 1):
        begun = np.ascontiguousarray(ways[:, :k]).view(f"S{k}").reshape(-1)
        child, first, number, weight = np.unique(begun, return_index=True, return_inverse=True, return_counts=True)
        levels.append(_children(child.tolist(), parent[first], np.arange(len(child)), weight.astype(float)))
        parent = number
    order = pa.compute.sort_indices(nodes.ids).to_numpy().astype(np.int64)
    order = order[np.argsort(parent[order], kind="stable")]
    levels.append(_children([nodes.names[k] for k in order.tolist()], parent[order], order, np.ones(len(order))))
    return levels


def _down(levels: list[list[Children]], heads: list[bytes]) -> list[int]:
    """The place of the node that each head comes to: all heads go down a level together, each with its parent's children."""
    at, leads = np.zeros(len(heads), np.int64), by_length(heads)
    for level in levels:
        best, rank, to = np.full(len(heads), -np.inf), np.full(len(heads), -1), np.zeros(len(heads), np.int64)
        for (which, lead), own in ((x, y) for x in leads for y in level):
            many = own.many[at[which]]
            head = np.flatnonzero(many)
            ends = np.cumsum(many[head])
            a = 0
            while a < len(head):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + MOST_SCORES, "right")))
                row, first = np.repeat(np.arange(b - a), many[head[a:b]]), ends[a:b] - many[head[a:b]] - done
                child = np.arange(len(row)) + (own.start[at[which[head[a:b]]]] - first)[row]
                score = np.log((first_words_of_pairs(lead, own.texts, head[a:b][row], child) + 0.5) / 4294967296.0) / own.weight[child]
                top = np.maximum.reduceat(score, first)
                # of equal ones the last
                equal = np.flatnonzero(score == top[row])
                last = child[equal[np.searchsorted(equal, ends[a:b] - done) - 1]]
                k = which[head[a:b]]
                better = (top > best[k]) | ((top == best[k]) & (own.rank[last] > rank[k]))
                k, last = k[better], last[better]
                best[k], rank[k], to[k] = top[better], own.rank[last], own.number[last]
                a = b
        at = to
    return at.tolist()


def placed(files: DataFrame, nodes: DataFrame, factor: int = REPLICATION_FACTOR, depth: int = 2) -> DataFrame:
    """file_id, node_id, nth: ``factor`` distinct online nodes for each file, found down a tree of groups of nodes.

    At each level a file goes to the child with the greatest ln(u) / weight, u being a hash of file, turn and child: every node is
    as likely as another, and when one goes only about a share of 1 / nodes of the files of each level move.  A file's work grows with the depth
    and the children of a level, sixteen and nodes / 16 ** ``depth``, not with all nodes.  A node that comes up again in a later
    turn is passed over, and only a file that lacks nodes takes a further turn; files that lack some after TURNS more turns than asked for are
    placed as ``rendezvous`` does.  Each task holds all nodes.
    """
    out = StructType([files.schema["file_id"], StructField("nodes", ArrayType(nodes.schema["node_id"].dataType))])
    arrow, turns = to_arrow_schema(out), factor + TURNS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, levels = None, []
        for own, batch in _with_nodes(batches):
            if own is not last:
                last, levels = own, _tree(own, depth)
            names = batch.column("_name").to_pylist()
            found: list[list[int]] = [[] for _ in names]
            lacking = list(range(len(names))) if len(own.names) >= factor else []
            for turn in range(1, turns + 1):
                heads = [b"%s%d:" % (b"" if names[k] is None else names[k] + b":", turn) for k in lacking]
                for k, n in zip(lacking, _down(levels, heads) if heads else []):
                    if n not in found[k]:
                        found[k].append(n)
                lacking = [k for k in lacking if len(found[k]) < factor]
            for k, n in enumerate(names):
                if len(found[k]) < factor:
                    found[k] = _ranked(own, None if n is None else n + b":", range(len(own.names)))[:factor]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, own.ids.take(pa.array([n for f in found for n in f], pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), lists], ["file_id", "nodes"]).cast(arrow)

    rows = files.select("file_id").distinct().withColumn("_name", F.col("file_id").cast("string").cast("binary"))
    chosen = _beside_nodes(rows, nodes).mapInArrow(place, out).select("file_id", F.posexplode("nodes").alias("nth", "node_id"))
    return chosen.select("file_id", "node_id", (F.col("nth") + 1).alias("nth"))


def first_nodes(files: DataFrame, nodes: DataFrame, factor: int = REPLICATION_FACTOR, order: str = "node_id", source: str = "source") -> DataFrame:
    """file_id, node_id, nth: the first online nodes by ``order`` other than the one in column ``source``; factor + 1 nodes decide for all files."""
    ids = [r[0] for r in nodes.where(F.col("status") == "online").orderBy(order).select("node_id").limit(factor + 1).collect()]
    others = F.slice(F.filter(F.array(*[F.lit(i) for i in ids]), lambda n: ~n.eqNullSafe(F.col(source))), 1, factor) if ids else F.array().cast("array<string>")
    return files.select("file_id", F.posexplode(others).alias("nth", "node_id")).select("file_id", "node_id", (F.col("nth") + 1).alias("nth"))


def replica_targets(files: DataFrame, nodes: DataFrame, affine: DataFrame, factor: int = REPLICATION_FACTOR, source: str = "source", order: str = "node_id") -> DataFrame:
    """file_id, node_id, nth: where replicas go: ``affine`` (file_id, node_id, nth) where it knows the file, else the first online nodes."""
    rest = files.join(affine.select("file_id"), "file_id", "left_anti")
    return affine.select("file_id", "node_id", "nth").unionByName(first_nodes(rest, nodes, factor, order, source))


def replication_results(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_id, replicated_to, failed, status: the targets of each file (at most the factor) by whether they are online.

    status is completed where all took it, failed where none did, partial else; it is the row of the replication log.
    """
    up = targets.join(nodes.where(F.col("status") == "online").select("node_id", F.lit(True).alias("up")), "node_id", "left")
    own = up.groupBy("file_id").agg(*[F.array_sort(F.collect_list(F.when(x, F.col("node_id")))).alias(a) for a, x in (("replicated_to", F.col("up").isNotNull()), ("failed", F.col("up").isNull()))])
    return own.withColumn("status", F.when(F.size("failed") == 0, "completed").when(F.size("replicated_to") == 0, "failed").otherwise("partial"))


def recoverable(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """checked, recoverable: replicas on offline nodes, and those of them whose file an online node holds too."""
    state = nodes.select("node_id", "status")
    held = files.join(state, "node_id")
    down, up = held.where("status = 'offline'"), held.where("status = 'online'").select("file_id").distinct().withColumn("up", F.lit(1))
    return down.join(up, "file_id", "left").agg(F.count(F.lit(1)).alias("checked"), F.count("up").alias("recoverable"))


def recovery_plan(files: DataFrame, nodes: DataFrame, failed, factor: int = REPLICATION_FACTOR) -> DataFrame:
    """file_id, node_id: where copies of the failed node's files go, chosen by rendezvous among nodes that don't hold them."""
    own = files.where(F.col("node_id") == failed).select("file_id").distinct()
    left = nodes.where(F.col("node_id") != failed)
    held = files.join(own, "file_id", "left_semi")
    holders = held.groupBy("file_id").agg(F.collect_set("node_id").alias("holders"))  # at most as many as there are nodes
    short = under_replicated(held, left, factor).select("file_id", F.col("missing").cast("int").alias("missing")).join(holders, "file_id")
    return rendezvous(short, left, factor, exclude="holders", wanted="missing").select("file_id", "node_id")


def task_status(tasks: DataFrame, file_id) -> DataFrame:
    """The task of one file with its status."""
    return task_states(tasks.where(F.col("file_id") == file_id))


def task_states(tasks: DataFrame) -> DataFrame:
    """tasks with status and progress: anything completed is completed, else anything failed is failed; no targets are complete."""
    done, failed, targets = F.size("completed_nodes"), F.size("failed_nodes"), F.size("target_nodes")
    status = F.when((targets == 0) | (done > 0), "completed").when(failed > 0, "failed").otherwise("pending")
    return tasks.withColumn("status", status).withColumn("progress", F.when(targets == 0, 1.0).otherwise(done / targets))


def task_counts(tasks: DataFrame) -> DataFrame:
    """status, tasks for each of the four states, zeros too."""
    states = F.explode(F.array(*[F.lit(s) for s in ("pending", "in_progress", "completed", "failed")])).alias("status")
    return tasks.sparkSession.range(1).select(states).join(tasks.groupBy("status").agg(F.count(F.lit(1)).alias("tasks")), "status", "left").select("status", F.coalesce("tasks", F.lit(0)).alias("tasks"))
