"""One object with the operators, for a session and a set of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .operators import checkpoints, namespace, registry, reliability, replication, routing, search, vectors
from .operators.text_index import TextIndex
from .sources import files as sources
from .streaming import discovery, elections, heartbeats


@dataclass
class Options:
    """Fixed defaults: dimensions, replicas, timeouts in seconds, days of reliability figures."""

    dimensions: int = 384
    replication_factor: int = 2
    heartbeat_timeout: int = 15
    discovery_expiry: int = 90
    node_timeout: int = 300
    stale_load: int = 30
    reliability_days: int = 30
    strategy: str = "weighted"
    stop_words: list[str] | None = None


@dataclass
class Engine:
    """Tables are DataFrames with the columns of ``quarrydex.schemas``; every method returns a new DataFrame."""

    spark: SparkSession
    options: Options = field(default_factory=Options)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    index: TextIndex | None = None

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"no table or method {name}") from None

    def documents(self) -> DataFrame:
        """Each file once, with its content: the replica that was updated last, then that of the greatest node."""
        columns = [c for c in self.files.columns if c != "file_id"]
        order = [c for c in ("last_updated", "node_id") if c in columns]
        files = self.files
        if len(order) == 1 and not any(isinstance(f.dataType, (MapType, VariantType)) for f in files.schema):
            # replicas that differ in nothing else are one row before rows are sorted
            files = files.groupBy("file_id", *[c for c in columns if c not in order]).agg(F.max(order[0]).alias(order[0]))
        latest = F.max_by(F.struct(*columns), F.struct(*order))
        one = files.groupBy("file_id").agg(latest.alias("x")).select("file_id", "x.*")
        contents = self.contents.groupBy("file_id").agg(F.max("content").alias("content"))
        return one.join(contents, "file_id", "left")

    def build_index(self, path: str, language: str | None = None) -> None:
        """Write the index of names and contents under ``path``; searches read it from then on.  ``language`` is a column of files."""
        self.index = TextIndex.build(self.documents(), path, ["name", "content"], kind="type", language=language, name="name", stop=self.options.stop_words)

    def open_index(self, path: str) -> None:
        self.index = TextIndex.open(self.spark, path)

    def search(self, query: str, file_type: str | None = None, max_results: int = 50, include_score: bool = True, language: str | None = None) -> DataFrame:
        """Hits of texts, or of names if no text matches; over the index once there is one, else over the texts."""
        if self.index is None:
            hits = search.search(self.documents(), query, file_type, max_results)
        else:
            hits = search.indexed_search(self.index, query, file_type, max_results, language)
        return hits if include_score else hits.drop("score")

    def names_like(self, pattern: str) -> DataFrame:
        """file_id, name by a glob over names, from the index."""
        return self.index.names_like(pattern)

    def result_files(self, hits: DataFrame, max_results: int | None = None) -> DataFrame:
        return search.with_files(hits, self.files, max_results)

    def embed_documents(self) -> DataFrame:
        docs = self.documents().withColumns({"description": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>")})
        return vectors.embedded(docs, self.options.dimensions)

    def embed_query(self, query: str) -> list[float]:
        return vectors.embedded_query(self.spark, query, self.options.dimensions)

    def nodes_available(self, hits: DataFrame) -> DataFrame:
        return search.nodes_of(hits, self.files, self.nodes.where("status = 'online'"))

    def index_documents(self, new: DataFrame) -> DataFrame:
        return registry.upsert(self.files, new, ["file_id", "node_id"], [F.desc("last_updated")])

    def knn(self, query, k: int = 10, nodes=None) -> DataFrame:
        return vectors.knn(self.vectors, query, k, nodes)

    def batch_similarity(self, queries: DataFrame) -> DataFrame:
        return vectors.batch_similarity(self.vectors, queries)

    def centroids(self) -> DataFrame:
        return vectors.centroids(self.vectors)

    def route_nodes(self, query, k: int = 3) -> DataFrame:
        return vectors.route(self.vectors, query, k)

    def routed_search(self, query, nodes: int = 3, k: int = 10, dedup: str = "first") -> DataFrame:
        return vectors.routed_search(self.vectors, query, nodes, k, dedup)

    def hybrid_search(self, text: str, query, k: int = 10) -> DataFrame:
        return vectors.fused(self.search(text, max_results=2 * k), self.knn(query, 2 * k), k=k)

    def select_nodes(self, scores: DataFrame | None = None, k: int = 3, now=None, **more) -> DataFrame:
        return routing.select_nodes(self.nodes, self.node_loads, scores, self.options.strategy, k, now=now, stale_seconds=self.options.stale_load, **more)

    def place_document(self, scores: DataFrame | None = None) -> DataFrame:
        return routing.place_document(self.nodes, self.node_loads, scores)

    def replica_nodes(self) -> DataFrame:
        return vectors.replica_nodes(self.vectors, self.options.replication_factor)

    def replication_plan(self) -> DataFrame:
        return replication.rendezvous(self.files.select("file_id").distinct(), self.nodes, self.options.replication_factor)

    def replica_targets(self, affine: DataFrame) -> DataFrame:
        files = self.files.groupBy("file_id").agg(F.min("node_id").alias("source"))
        return replication.replica_targets(files, self.nodes, affine, self.options.replication_factor)

    def recovery_plan(self, failed) -> DataFrame:
        return replication.recovery_plan(self.files, self.nodes, failed, self.options.replication_factor)

    def conflicts(self) -> DataFrame:
        return replication.conflicts(self.files)

    def canonical_versions(self, strategy: str = "last_write_wins") -> DataFrame:
        return replication.canonical(self.files, strategy)

    def replication_status(self) -> DataFrame:
        return replication.replication_status(self.files, self.options.replication_factor)

    def missing_replicas(self) -> DataFrame:
        return replication.under_replicated(self.files, self.nodes, self.options.replication_factor)

    def index_stats(self) -> DataFrame:
        return registry.index_stats(self.files, self.nodes)

    def cluster_health(self, now=None) -> DataFrame:
        return registry.cluster_health(self.nodes, self.system_reliability(now).drop("nodes"))

    def register_paths(self, new: DataFrame) -> DataFrame:
        return namespace.paths(new)

    def resolve(self, requests: DataFrame) -> DataFrame:
        return namespace.resolve(requests, self.paths, self.aliases)

    def list_directory(self, path: str) -> DataFrame:
        return namespace.list_directory(self.paths, path)

    def glob(self, pattern: str) -> DataFrame:
        return namespace.search_glob(self.paths, pattern)

    def tree(self, root: str = "/", depth: int = 3) -> DataFrame:
        return namespace.subtree(self.paths, root, depth)

    def delete_path(self, path: str, recursive: bool = False) -> DataFrame:
        return namespace.delete_path(self.paths, path, recursive)

    def create_alias(self, new: DataFrame) -> DataFrame:
        return namespace.create_aliases(self.aliases, new, self.paths)

    def node_metrics(self, now=None) -> DataFrame:
        return reliability.node_metrics(self.failures, now, self.options.reliability_days)

    def system_reliability(self, now=None) -> DataFrame:
        return reliability.system_metrics(self.failures, self.nodes, now, self.options.reliability_days)

    def record_failure(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        return reliability.record_failure(self.failures, self.nodes, new)

    def recount(self) -> DataFrame:
        return registry.recount(self.nodes, self.files)

    def upload(self, folder: str, node_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return sources.upload(self.scan_directory(folder, node_id), node_id)

    def import_folder(self, folder: str, node_id: str) -> DataFrame:
        return sources.import_folder(self.spark, folder, node_id)

    def checkpoint(self, now) -> DataFrame:
        return checkpoints.checkpoint(self.files, now)

    def snapshot(self, now) -> DataFrame:
        return checkpoints.snapshot(self.files, now)

    def verify(self, points: DataFrame, snapshots: DataFrame) -> DataFrame:
        return checkpoints.verify(points, snapshots)

    def restore(self, snapshots: DataFrame) -> DataFrame:
        return checkpoints.restore(self.files, snapshots)

    def scan_directory(self, folder: str, node_id: str) -> DataFrame:
        return sources.scan_directory(self.spark, folder, node_id)

    def sync_directory(self, folder: str, node_id: str) -> DataFrame:
        return registry.sync_directory(self.files.where(F.col("node_id") == node_id), self.scan_directory(folder, node_id))

    def heartbeat_stream(self, messages: DataFrame) -> DataFrame:
        """node_down and node_up of known nodes from a stream of pings and pongs (type, sender_id, timestamp)."""
        return heartbeats.heartbeat_stream(heartbeats.of_peers(messages, self.nodes), self.options.heartbeat_timeout)

    def discovery_stream(self, raw: DataFrame) -> DataFrame:
        return discovery.sessions(discovery.parse_announcements(raw), self.options.discovery_expiry, f"{self.options.discovery_expiry} seconds")

    def leader_history(self, messages: DataFrame) -> DataFrame:
        return elections.leader_history(messages)

    def timeout_sweep(self, now, own=None) -> DataFrame:
        return registry.timeout_sweep(self.nodes, now, self.options.node_timeout, own)

    def latest_activities(self, limit: int = 50) -> DataFrame:
        return registry.latest_activities(self.activities, limit)
