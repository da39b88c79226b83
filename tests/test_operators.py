"""Hand-computed cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrydex import schemas
from quarrydex.engine import Engine, Options
from quarrydex.operators.text_index import TextIndex
from quarrydex.functions import scalars as S
from quarrydex.functions.text import glob
from quarrydex.functions.vectors import hashed_embedding
from quarrydex.operators import checkpoints, namespace, registry, reliability, replication, routing, search, vectors
from quarrydex.sources import files as sources

T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def one(spark, sql_type, value, column):
    return spark.createDataFrame([(value,)], f"x {sql_type}").select(column(F.col("x"))).first()[0]


@pytest.fixture
def vec(spark):
    return spark.createDataFrame([("d1", "node-1", [1.0, 0.0, 0.0, 0.0]), ("d2", "node-2", [0.0, 1.0, 0.0, 0.0]), ("d3", "node-3", [0.7, 0.7, 0.0, 0.0])], "file_id string, node_id string, embedding array<double>")


def test_neighbours(vec):
    assert [r.node_id for r in vectors.knn(vec, [0.9, 0.1, 0, 0], 3).collect()] == ["node-1", "node-3", "node-2"]
    assert [r.node_id for r in vectors.knn(vec, [0.9, 0.1, 0, 0], 3, ["node-2"]).collect()] == ["node-2"]
    assert vectors.knn(vec, [1, 0, 0, 0], 0).count() == 0
    assert vectors.knn(vec, [1, 0, 0, 0], 99).count() == 3
    assert [r.score for r in vectors.knn(vec, [0, 0, 0, 0], 3).collect()] == [0, 0, 0]
    assert [r.node_id for r in vectors.route(vec, [0.95, 0.05, 0, 0], 2).collect()] == ["node-1", "node-3"]


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([("b", "n", [1.0, 0.0]), ("a", "n", [1.0, 0.0])], "file_id string, node_id string, embedding array<double>")
    assert [r.file_id for r in vectors.knn(df, [1, 0], 2).collect()] == ["a", "b"]


def test_wrong_dimension_fails(spark, vec):
    new = spark.createDataFrame([("doc-1", "node-a", [1.0, 1.0, 1.0])], vec.schema)
    with pytest.raises(Exception, match="dimensions"):
        vectors.register(vec, new, 4).collect()


def test_replicas_leave_out_their_own_node(vec):
    got = {(r.file_id, r.node_id) for r in vectors.replica_nodes(vec, 2).collect()}
    assert {n for f, n in got if f == "d1"} == {"node-2", "node-3"}


def test_moved_document_changes_both_centroids(vec):
    moved = vectors.register(vec, vec.where("file_id = 'd3'").withColumn("node_id", F.lit("node-1")), 4)
    assert {r.node_id: r.document_count for r in vectors.centroids(moved).collect()} == {"node-1": 2, "node-2": 1}


def test_search_and_fallback(spark):
    docs = spark.createDataFrame([("1", "test_e2e.txt", "document", "Este es un documento de prueba E2E"), ("2", "Informe Anual.pdf", "document", "ventas"), ("3", "photo.png", "image", "prueba")], "file_id string, name string, type string, content string")
    assert [r.file_id for r in search.search(docs, "documento prueba E2E").collect()][0] == "1"
    assert [(r.file_id, r.matched) for r in search.search(docs, "prueba", "image").collect()] == [("3", "text")]
    assert [(r.file_id, r.matched) for r in search.search(docs, "form").collect()] == [("2", "name")]
    assert search.search(docs, "  ").count() == 0
    assert search.search(docs, "a+b(").count() == 0


def test_strategies(spark):
    nodes = spark.createDataFrame([("a", "online"), ("b", "online"), ("c", "offline"), ("d", "online")], "node_id string, status string")
    loads = spark.createDataFrame([("a", 5, 50.0, 50.0, 10, at(0)), ("b", 1, 10.0, 10.0, 20, at(100))], "node_id string, active_queries int, cpu_usage double, memory_usage double, document_count bigint, last_updated timestamp")
    scores = spark.createDataFrame([("a", 0.9), ("c", 1.0)], "node_id string, score double")
    pick = lambda **k: [r.node_id for r in routing.select_nodes(nodes, loads, **k).collect()]
    assert pick(strategy="least_connections", k=2) == ["d", "b"]
    assert pick(strategy="round_robin", k=2) == ["b", "d"]
    assert pick(strategy="semantic", scores=scores, k=2) == ["a"]
    got = routing.select_nodes(nodes, loads, scores, "weighted", 9, now=F.lit(at(100))).collect()
    assert [(r.node_id, r.score) for r in got] == [("a", 0.74), ("d", 0.7), ("b", 0.3 + 0.4 * 0.9)]
    assert routing.place_document(nodes, loads, scores).first().node_id == "d"
    assert pick(k=2, exclude=["a", "b", "d"]) == []


def test_active_queries_never_fall_below_zero(spark):
    events = spark.createDataFrame([("a", k, d) for k, d in enumerate([-1, 1, 1, -1, -1, -1, 1])], "node_id string, timestamp int, delta int")
    assert [r.active_queries for r in routing.active_queries(events).orderBy("timestamp").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_versions(spark):
    files = spark.createDataFrame([("f", "n1", "x", at(1)), ("f", "n2", "y", at(2)), ("f", "n0", "y", at(2)), ("g", "n1", "", None), ("g", "n2", "z", None)], "file_id string, node_id string, content_hash string, last_updated timestamp")
    nodes = spark.createDataFrame([("n0", "online"), ("n1", "online"), ("n2", "offline")], "node_id string, status string")
    assert [r.file_id for r in replication.conflicts(files).collect()] == ["f"]
    assert {r.file_id: r.node_id for r in replication.canonical(files).collect()} == {"f": "n0", "g": "n1"}
    assert [tuple(r) for r in replication.outdated(files, nodes).collect()] == [("f", "n1", "n0", "y")]
    assert tuple(replication.synchronise(files, nodes).first()) == (2, 1, 1)
    assert tuple(replication.replication_status(files, 3).first()) == (2, 5, 1, 1, 50.0)
    assert tuple(replication.replication_status(files.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    assert tuple(replication.recoverable(files, nodes).first()) == (2, 2)
    plan = replication.recovery_plan(files, nodes, "n1", 2).collect()
    assert [(r.file_id, r.node_id) for r in plan] == [("g", "n0")]


def test_tasks(spark):
    tasks = spark.createDataFrame([("f1", [], [], []), ("f2", ["b"], ["b"], []), ("f3", ["b", "c"], [], ["b"])], "file_id string, target_nodes array<string>, completed_nodes array<string>, failed_nodes array<string>")
    got = replication.task_states(tasks).orderBy("file_id").collect()
    assert [(r.status, r.progress) for r in got] == [("completed", 1.0), ("completed", 1.0), ("failed", 0.0)]
    assert {r.status: r.tasks for r in replication.task_counts(replication.task_states(tasks)).collect()} == {"pending": 0, "in_progress": 0, "completed": 2, "failed": 1}


def test_namespace(spark):
    files = spark.createDataFrame([("a//b/c.txt", "1"), ("/a/d.txt", "2"), ("/a.b/x", "3"), ("/aXb/c", "4"), ("/", "5")], "path string, file_id string")
    tree = namespace.paths(files).cache()
    assert [(r.name, r.is_file) for r in namespace.list_directory(tree, "a/").collect()] == [("b", False), ("d.txt", True)]
    assert {r.path for r in namespace.search_glob(tree, "/a/*.txt").collect()} == {"/a/b/c.txt", "/a/d.txt"}
    assert {r.path for r in namespace.deleted_by(tree, "/a.b", True).collect()} == {"/a.b", "/a.b/x"}
    assert namespace.deleted_by(tree, "/a").count() == 0
    assert {r.path for r in namespace.subtree(tree, "/", 1).where("truncated").collect()} == {"/a", "/a.b", "/aXb"}
    aliases = namespace.create_aliases(spark.createDataFrame([("/k", "/l")], schemas.ALIASES), spark.createDataFrame([("/l", "/a/d.txt"), ("/m", "/a"), ("/n", "/none")], schemas.ALIASES), tree)
    assert {r.alias for r in aliases.collect()} == {"/k", "/l"}
    asked = spark.createDataFrame([("l",), ("k",), ("/a",), ("/a/d.txt",)], "path string")
    assert {r.requested: r.file_id for r in namespace.resolve(asked, tree, aliases).collect()} == {"l": "2", "k": None, "/a": None, "/a/d.txt": "2"}


def test_reliability(spark):
    day = 86400
    rows = [("n1", at(0), at(10), 10.0), ("n1", at(110), at(130), 20.0), ("n2", at(0), at(5), 5.0), ("n3", at(0), None, None)]
    failures = spark.createDataFrame(rows, "node_id string, timestamp timestamp, recovery_time timestamp, downtime_seconds double")
    got = {r.node_id: tuple(r)[1:] for r in reliability.node_metrics(failures).collect()}
    assert got == {"n1": (2, 15.0, 100.0, 115.0, round(100 / 115, 6)), "n2": (1, 5.0, 0.0, 5.0, 0.0)}
    assert reliability.node_metrics(failures, F.lit(at(31 * day))).count() == 0
    assert [r.node_id for r in reliability.open_failures(failures).collect()] == ["n3"]
    nodes = spark.createDataFrame([("n1", "online"), ("n9", "online")], "node_id string, status string")
    assert reliability.system_metrics(failures, nodes).first().availability == round((1 + 100 / 115) / 2, 6)
    closed = reliability.record_recovery(failures, spark.createDataFrame([("n3", at(40))], "node_id string, timestamp timestamp"))
    assert closed.where("node_id = 'n3'").first().downtime_seconds == 40.0


def test_checkpoints(spark):
    files = spark.createDataFrame([("a", "1", "h1", at(1)), ("a", "2", None, None), ("b", "3", "h3", at(3))], "node_id string, file_id string, content_hash string, last_updated timestamp")
    points = checkpoints.checkpoint(files, F.lit(at(9))).cache()
    snapshot = checkpoints.snapshot(files, F.lit(at(9)))
    assert all(r.valid for r in checkpoints.verify(points, snapshot).collect())
    assert not any(r.valid for r in checkpoints.verify(points, snapshot.withColumn("content_hash", F.lit("evil"))).collect())
    assert {r.node_id: r.valid for r in checkpoints.verify(points, snapshot.where("node_id = 'a'")).collect()} == {"a": True, "b": False}
    changed = files.where("file_id <> '1'").withColumn("content_hash", F.lit("new"))
    back = checkpoints.restore(changed, snapshot.where("node_id = 'a'"))
    assert {(r.node_id, r.file_id, r.content_hash) for r in back.collect()} == {("a", "1", "h1"), ("a", "2", None), ("b", "3", "new")}
    assert checkpoints.coordinated(points).first().total_files == 3


def test_registry(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y")], "file_id string, name string, content string")
    new = spark.createDataFrame([("2", "b", " "), ("3", "c", None)], old.schema)
    assert {r.file_id: r.content for r in registry.upsert_contents(old, new).collect()} == {"1": "x", "2": "y", "3": None}
    assert registry.check_unique(old.union(old), ["file_id"]).count() == 2
    nodes = spark.createDataFrame([("a", "online", at(0)), ("b", "online", at(299)), ("c", "online", at(-1))], "node_id string, status string, last_seen timestamp")
    swept = {r.node_id: r.status for r in registry.timeout_sweep(nodes, F.lit(at(300)), 300, "c").collect()}
    assert swept == {"a": "online", "b": "online", "c": "online"}
    assert registry.timeout_sweep(nodes, F.lit(at(300)), 300).where("status = 'offline'").first().node_id == "c"
    again = registry.register_nodes(nodes.withColumn("status", F.lit("offline")), spark.createDataFrame([("a",), ("z",)], "node_id string"))
    assert {(r.node_id, r.status, r.outcome) for r in again.where("outcome is not null").collect()} == {("a", "offline", "updated"), ("z", "online", "registered")}
    sync = registry.sync_directory(spark.createDataFrame([("1", "h"), ("2", "h")], "file_id string, content_hash string"), spark.createDataFrame([("2", "i"), ("3", "h")], "file_id string, content_hash string"))
    assert {r.file_id: r.action for r in sync.collect()} == {"1": "delete", "2": "update", "3": "add"}


@pytest.mark.parametrize(("text", "size"), [("é" * 3, 5), ("aé€😀", 9), ("abc", 2), ("abc", 9)])
def test_truncation_keeps_characters_whole(spark, text, size):
    want = text.encode()[:size].decode("utf-8", "ignore")
    assert one(spark, "string", text, lambda x: S.truncate_bytes(x, size)) == want


def test_scalars(spark):
    assert one(spark, "string", "x/Report.PDF", S.type_by_extension) == "document"
    assert one(spark, "string", "noext", S.type_by_extension) == "other"
    assert one(spark, "string", "a//b/", S.normal_path) == "/a/b"
    assert one(spark, "bigint", 1536, S.human_size) == "1.5 KB"
    assert one(spark, "string", "NodeStatus.OFFLINE", S.normal_status) == "offline"
    assert one(spark, "string", None, S.normal_status) == "unknown"
    assert one(spark, "binary", b"\xe9t\xe9", S.decoded) == "été"
    assert one(spark, "array<string>", ["a", "b"], lambda x: F.size(hashed_embedding(x, 16))) == 16


def test_message_frames(spark):
    df = spark.createDataFrame([("PING", "node-a", {"k": "v"}, T), ("NONE", "node-a", {}, T)], "type string, sender string, payload map<string,string>, ts timestamp")
    framed = df.select(S.frame(F.col("type"), F.col("sender"), F.col("payload"), F.col("ts")).alias("b"))
    got = framed.select(S.unframe(F.col("b")).alias("m")).collect()
    assert (got[0].m.type, got[0].m.sender_id, got[0].m.payload, got[0].m.timestamp) == ("PING", "node-a", {"k": "v"}, T)
    assert got[1].m is None
    assert one(spark, "binary", b"rubbish", S.unframe) is None


def test_glob():
    import re

    assert re.match(glob("/a/[bc]?.t*"), "/a/bx.txt/more") and not re.match(glob("/a/[!bc]"), "/a/b")


def test_scan(spark, tmp_path):
    for name, data in {"a.txt": b"hola", "sub/b.py": b"print(1)", ".hidden": b"x", "node_modules/c.js": b"x", "d.pyc": b"x", "e.bin": b"\x00\x01"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    found = sources.scan_directory(spark, str(tmp_path), "node-a").cache()
    assert {(r.path, r.type, r.content) for r in found.collect()} == {("a.txt", "document", "hola"), ("sub/b.py", "code", "print(1)"), ("e.bin", "other", None)}
    assert tuple(sources.scan_totals(found).first())[:2] == (3, 14)
    files, contents = sources.split_ingest(found)
    assert "content" not in files.columns and contents.count() == 2
    engine = Engine(spark, Options(), {"files": files.limit(0)})
    assert {r.action for r in engine.sync_directory(str(tmp_path), "node-a").collect()} == {"add"}


def test_engine_search(spark):
    files = spark.createDataFrame([("1", "n", "doc.txt", "document", 3), ("1", "m", "doc.txt", "document", 3)], "file_id string, node_id string, name string, type string, size bigint")
    contents = spark.createDataFrame([("1", "doc.txt", "hello world")], schemas.CONTENTS)
    nodes = spark.createDataFrame([("n", "online"), ("m", "offline")], "node_id string, status string")
    engine = Engine(spark, Options(), {"files": files, "contents": contents, "nodes": nodes})
    hits = engine.search("hello")
    assert [r.file_id for r in hits.collect()] == ["1"]
    assert [r.node_id for r in engine.nodes_available(hits).collect()] == ["n"]
    assert tuple(engine.index_stats().first()) == (2, 6, 1, 1, 2)


def test_index_equals_texts(spark, tmp_path):
    rows = [("1", "red car", "a red car and a blue one", "a"), ("2", "blue boat", "sea " * 30, "b"), ("3", None, "the car", "a"), ("4", "", None, None), ("5", "Red red RED", "red", "b")]
    docs = spark.createDataFrame(rows, "file_id string, name string, content string, type string")
    index = TextIndex.build(docs, str(tmp_path / "index"), ["name", "content"], kind="type")
    for query in ("red", "car BLUE", "sea boat the", "nothing", "", " "):
        want = [tuple(r) for r in search.weighted_search(docs, query).collect()]
        assert [tuple(r) for r in index.search(query).collect()] == want, query
    assert {r.file_id for r in index.search("red car", kind="a").collect()} == {"1", "3"}
    plan = index._of(index.postings, [("name", "red")])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "xxhash64(red" not in plan.split("== Physical Plan ==")[1].split("PartitionFilters")[1][:200]


def test_hits_keep_their_order(spark):
    hits = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 9.0)], "file_id string, score double")
    files = spark.createDataFrame([("a", "n2"), ("a", "n1"), ("c", "n1"), ("b", "n3")], "file_id string, node_id string")
    got = search.with_files(hits, files, 2).collect()
    assert [(r.nth, r.file_id, r.node_id) for r in got] == [(1, "c", "n1"), (2, "a", "n1"), (2, "a", "n2")]


@pytest.mark.parametrize("block, spare", [(10_000, 40), (7, 1), (7, 0)])
def test_rendezvous_equals_ranking_all(spark, monkeypatch, block, spare):
    import hashlib

    monkeypatch.setattr(replication, "BLOCK", block)
    monkeypatch.setattr(replication, "SPARE", spare)
    nodes = spark.createDataFrame([(f"n{k}", "online" if k % 5 else "offline") for k in range(60)], "node_id string, status string")
    files = spark.createDataFrame([(f"f{k}", f"n{k % 60}", [f"n{j}" for j in range(k % 50)], k % 4) for k in range(80)], "file_id string, source string, held array<string>, missing int")
    got = {}
    for r in replication.rendezvous(files, nodes, 2, source="source", exclude="held", wanted="missing").orderBy("nth").collect():
        got.setdefault(r.file_id, []).append(r.node_id)
    for k in range(80):
        free = [f"n{j}" for j in range(60) if j % 5 and j != k % 60 and j >= k % 50]
        want = sorted(free, key=lambda n: hashlib.md5(f"f{k}:{n}".encode()).hexdigest())[: k % 4]
        assert got.get(f"f{k}", []) == want
    assert replication.rendezvous(files, nodes.limit(0)).count() == 0


def test_a_file_with_several_sources_is_placed_for_each(spark):
    nodes = spark.createDataFrame([(k, "online") for k in range(3)], "node_id int, status string")
    files = spark.createDataFrame([("f", 0), ("f", 1), ("f", 1), (None, None), ("g", None)], "file_id string, source int")
    got = {}
    for r in replication.rendezvous(files, nodes, 2, source="source").collect():
        got.setdefault(r.file_id, []).append(r.node_id)
    assert sorted(got["f"]) == [0, 1, 2, 2] and len(set(got["g"])) == 2  # the others of source 0, and of source 1


def test_tree_places_on_distinct_nodes_and_moves_little(spark):
    nodes = spark.createDataFrame([(f"node-{k}", "online" if k != 7 else "offline") for k in range(120)], "node_id string, status string")
    files = spark.createDataFrame([(f"f{k}",) for k in range(1500)], "file_id string")
    place = lambda n: {(r.file_id, r.nth): r.node_id for r in replication.placed(files, n, 3).collect()}
    before = place(nodes)
    held = {}
    for (f, _), n in before.items():
        held.setdefault(f, set()).add(n)
    assert len(held) == 1500 and all(len(h) == 3 for h in held.values()) and "node-7" not in set(before.values())
    share = sorted(list(before.values()).count(f"node-{k}") for k in range(120) if k != 7)
    assert share[0] > 0.4 * 4500 / 119 and share[-1] < 2 * 4500 / 119
    after = place(nodes.where("node_id <> 'node-50'"))
    moved = sum(len(held[f] - {after[f, k] for k in (1, 2, 3)}) for f in held)
    own = sum(n == "node-50" for n in before.values())
    assert own <= moved < 4 * 4500 / 119
    few = spark.createDataFrame([("a", "online"), ("b", "online"), ("c", "offline")], "node_id string, status string")
    assert {(r.file_id, r.node_id) for r in replication.placed(files.limit(2), few, 3).collect()} == {(f, n) for (f,) in files.limit(2).collect() for n in "ab"}
    assert replication.placed(files, nodes.limit(0)).count() == 0


def test_more_nodes_than_one_block(spark, monkeypatch):
    rows = [(k, k % 9, [float(k % 7), float(k % 5), 1.0]) for k in range(90)]
    vec = spark.createDataFrame(rows, "file_id int, node_id int, embedding array<double>")
    want = sorted(map(tuple, vectors.replica_nodes(vec, 3).collect()))
    asked = vec.where("file_id < 20").select(F.col("file_id").alias("query_id"), "embedding")
    scores = sorted(map(tuple, vectors.batch_similarity(vec, asked).collect()))
    monkeypatch.setattr(vectors, "NODES_AT_ONCE", 2)
    monkeypatch.setattr(vectors, "BATCH", 3)
    assert sorted(map(tuple, vectors.replica_nodes(vec, 3).collect())) == want
    assert sorted(map(tuple, vectors.batch_similarity(vec, asked).collect())) == scores and len(scores) == 1800


def test_targets_and_results(spark):
    nodes = spark.createDataFrame([("a", "online"), ("b", "online"), ("c", "online"), ("d", "offline")], "node_id string, status string")
    files = spark.createDataFrame([("f", "a"), ("g", "c"), ("h", "b")], "file_id string, source string")
    affine = spark.createDataFrame([("h", "d", 1), ("h", "c", 2)], "file_id string, node_id string, nth int")
    got = replication.replica_targets(files, nodes, affine).orderBy("file_id", "nth")
    assert [(r.file_id, r.node_id) for r in got.collect()] == [("f", "b"), ("f", "c"), ("g", "a"), ("g", "b"), ("h", "d"), ("h", "c")]
    log = {r.file_id: (r.replicated_to, r.failed, r.status) for r in replication.replication_results(got, nodes).collect()}
    assert log["f"] == (["b", "c"], [], "completed") and log["h"] == (["c"], ["d"], "partial")
    assert replication.first_nodes(files, nodes.limit(0)).count() == 0


def test_engine_surface(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"hello there")
    engine = Engine(spark, Options(dimensions=16))
    files, contents, counts = engine.upload(str(tmp_path / "in"), "n1")
    assert tuple(counts.first()) == (1, 1, 0) and files.first().file_id.startswith("n1_")
    assert engine.import_folder(str(tmp_path / "in"), "n1").columns == [c for c in files.columns if c != "content_hash"]
    nodes = spark.createDataFrame([("n1", "online"), ("n2", "online")], "node_id string, status string")
    engine = Engine(spark, Options(dimensions=16), {"files": files, "contents": contents, "nodes": nodes, "failures": spark.createDataFrame([], "node_id string, timestamp timestamp")})
    engine.build_index(str(tmp_path / "index"))
    hits = engine.search("HELLO", "document")
    assert hits.count() == 1 and [r.node_id for r in engine.result_files(hits).collect()] == ["n1"]
    near = engine.embed_documents().first().embedding
    assert len(near) == 16 and len(engine.embed_query("hello")) == 16
    failures, marked = engine.record_failure(spark.createDataFrame([("n1", at(3))], "node_id string, timestamp timestamp"))
    assert failures.count() == 1 and {r.node_id: r.status for r in marked.collect()} == {"n1": "offline", "n2": "online"}
    assert {r.node_id: r.shared_files_count for r in engine.recount().collect()} == {"n1": 1, "n2": 0}
    assert [r.node_id for r in engine.recovery_plan("n1").collect()] == ["n2"]


def test_plans(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(100).selectExpr("id AS file_id", "id % 5 AS node_id", "array(1.0D, cast(id AS double)) AS embedding", "repeat('x', 100) AS text").write.parquet(path)
    plan = vectors.knn(spark.read.parquet(path), [1, 0], 5, [1])._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(node_id,1)" in plan.replace("In(node_id, [1])", "EqualTo(node_id,1)")
    assert "text:string" not in plan.split("ReadSchema")[1]


def test_first_words_are_those_of_md5():
    import hashlib

    import numpy as np

    from quarrydex.functions import md5

    for lead, size, heads, tails in ((0, 1, 3, 200), (3, 5, 1, 300), (8, 4, 40, 20), (51, 4, 2, 400), (52, 4, 2, 400), (130, 70, 1, 300), (64, 1, 3, 2)):
        own, others = ([np.random.default_rng(k).bytes(n) for k in range(many)] for n, many in ((lead, heads), (size, tails)))
        found = np.zeros((heads, tails), np.int64)
        for (which, a) in md5.by_length(own):
            for (index, b) in md5.by_length(others):
                for i, j, numbers in md5.first_words(a, b):
                    found[np.ix_(which[i : i + len(numbers)], index[j : j + numbers.shape[1]])] = numbers
        assert found.tolist() == [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in others] for h in own]


def test_tree_takes_the_turns_that_are_needed(spark):
    """The nodes are those of all turns, but no file is multiplied by its turns."""
    import hashlib
    import math

    ids = [k * k for k in range(60)]
    nodes = spark.createDataFrame([(k, "online") for k in ids], "node_id int, status string")
    files = spark.range(40).selectExpr("id AS file_id")
    got = {}
    placed = replication.placed(files, nodes, 3, depth=1)
    for r in placed.orderBy("nth").collect():
        got.setdefault(r.file_id, []).append(r.node_id)
    way = {k: hashlib.md5(str(k).encode()).hexdigest()[0] for k in ids}
    u = lambda *x: (int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    for f in range(40):
        found = []
        for turn in range(1, 10):
            group = max(sorted(set(way.values())), key=lambda c: math.log(u(f, turn, c)) / list(way.values()).count(c))
            best = max((k for k in ids if way[k] == group), key=lambda k: u(f, turn, k))
            found += [best] if best not in found else []
        assert got[f] == found[:3]
    assert "Generate explode(sequence(1" not in placed._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in placed._jdf.queryExecution().executedPlan().toString()


def test_files_of_all_groups_go_down_the_tree_together(monkeypatch):
    """Few large calls whatever the groups are; lengths of ids differ, and the nodes are those of the plain rule."""
    import hashlib
    import math

    import pyarrow as pa

    from quarrydex.functions import md5

    ids = [3 * k for k in range(3000)]
    names = [str(k).encode() for k in ids]
    levels = replication._tree(replication.Nodes(pa.array(ids), names, md5.by_length(names)), 2)
    heads, calls, plain = [b"%d:1:" % f for f in range(0, 9000, 11)], [], md5._digested
    monkeypatch.setattr(md5, "_digested", lambda words, n: calls.append(n) or plain(words, n))
    got = replication._down(levels, heads)
    assert len(calls) < 60 and sum(calls) > 33_000
    way = [hashlib.md5(n).hexdigest() for n in names]
    u = lambda head, child: (int(hashlib.md5(head + child).hexdigest()[:8], 16) + 0.5) / 2**32
    for head, place in list(zip(heads, got))[::16]:
        own = ""
        for depth in (1, 2):
            below = [w[:depth] for w in way if w.startswith(own)]
            own = max(set(below), key=lambda c: math.log(u(head, c.encode())) / below.count(c))
        assert place == max((k for k in range(len(ids)) if way[k].startswith(own)), key=lambda k: u(head, names[k]))


def test_under_replicated_files_need_no_windows_and_no_sets(spark):
    """Repeated rows, unknown and offline nodes and null ids, for each factor; up to two copies nothing but files is grouped by."""
    rows = [(1, 1), (1, 1), (1, 2), (2, 1), (2, 1), (2, 9), (3, 3), (3, 7), (4, None), (None, 2), (5, 1), (5, 2), (5, 4), (6, 3)]
    nodes = {1: "online", 2: "online", 3: "offline", 4: "online"}
    files, table = spark.createDataFrame(rows, "file_id int, node_id int"), spark.createDataFrame(list(nodes.items()), "node_id int, status string")
    for factor in (0, 1, 2, 3):
        want = {f: len({n for g, n in rows if g == f and nodes.get(n) == "online"}) for f, _ in rows}
        got = replication.under_replicated(files, table, factor)
        assert {(r.file_id, r.holders, r.missing) for r in got.collect()} == {(f, n, factor - n) for f, n in want.items() if n < factor}
    plan = replication.under_replicated(files, table)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[file_id" in plan and "keys=[file_id#" in plan and not [x for x in plan.splitlines() if "keys=[file_id" in x and "node_id" in x.split("functions=")[0]]
    from quarrydex.plans import catalog

    assert "Window" not in catalog.QUERIES["under_replicated_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_replicas_of_a_few_hits_are_looked_up_by_id(spark, tmp_path, monkeypatch):
    """Ids of hits reach the tables that files are made of; with more hits than are looked up the rows are the same."""
    spark.range(500).selectExpr("id % 100 AS file_id", "id % 7 AS node_id").write.parquet(str(tmp_path / "held"))
    names = spark.range(100).selectExpr("id AS file_id", "concat('n', id) AS name")
    files = names.join(spark.read.parquet(str(tmp_path / "held")).distinct(), "file_id", "left")
    hits = spark.createDataFrame([(3, 1.0), (5, 2.0), (4, 2.0), (None, 9.0), (1000, 0.5)], "file_id bigint, score double")
    rows = lambda limit: [(r.nth, r.file_id, r.score, r.node_id, r.name) for r in search.with_files(hits, files, limit).collect()]
    plan = search.with_files(hits, files)._jdf.queryExecution().executedPlan().toString()
    assert "In(file_id" in plan
    few = {limit: rows(limit) for limit in (None, 3, 0)}
    assert [x[:3] for x in few[3]] == [(2, 4, 2.0)] * 5 + [(3, 5, 2.0)] * 5 and len(few[None]) == 15 and not few[0]
    monkeypatch.setattr(search, "MOST_NAMED", 2)
    assert {limit: rows(limit) for limit in (None, 3, 0)} == few


def test_documents_are_the_greatest_nodes_whatever_replicas_differ_in(spark):
    files = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "a", 2), (2, "c", None), (2, "c", None), (3, None, 4), (3, "d", 1)], "file_id int, name string, node_id int")
    contents = spark.createDataFrame([(1, "x")], "file_id int, content string")
    documents = Engine(spark, tables={"files": files, "contents": contents}).documents()
    assert sorted((r.file_id, r.name, r.node_id, r.content) for r in documents.collect()) == [(1, "b", 3, "x"), (2, "c", None, None), (3, None, 4, None)]
    assert "keys=[file_id#" in (plan := documents._jdf.queryExecution().executedPlan().toString()) and "max(node_id" in plan


def test_a_checkpoint_is_verified_along_with_its_counts(spark):
    """The digest is that of ranges' digests in hexadecimal digits, whatever goes through the shuffle; counts come from the same pass."""
    import hashlib

    rows = [("a", f"f{k}", f"h{k}", at(8)) for k in range(50)] + [("b", "f1", None, None)]
    files = spark.createDataFrame(rows, "node_id string, file_id string, content_hash string, last_updated timestamp")
    points = checkpoints.checkpoint(files, F.lit(at(9)))
    sha = lambda entries: hashlib.sha256(",".join(sorted(entries)).encode()).hexdigest()
    for node in "ab":
        ranges = {}
        for n, f, h, t in rows:
            if n == node:
                stamp = t.strftime("%Y-%m-%d %H:%M:%S.%f") if t else ""
                ranges.setdefault(hashlib.md5(f.encode()).hexdigest()[:3], []).append(f"{f}|{h or ''}|{stamp}")
        assert points.where(F.col("node_id") == node).first().checkpoint_hash == sha(f"{p}:{sha(e)}" for p, e in ranges.items())
    snapshot = checkpoints.snapshot(files.where("file_id <> 'f7'"), F.lit(at(9)))
    got = checkpoints.verify(points, snapshot, ["files_count"]).collect()
    assert sorted(map(tuple, got)) == [("a", False, 50), ("b", True, 1)]


def test_batches_are_products_of_matrices(spark):
    from quarrydex.functions import vectors as V

    rows = [(k, 0, [float(k % 7) - 3, float(k % 5), 0.5 * k]) for k in range(700)] + [(700, 0, None), (701, 0, [1.0, None, 2.0]), (702, 0, [1.0]), (703, 0, [0.0, 0.0, 0.0])]
    vec = spark.createDataFrame(rows, "file_id int, node_id int, embedding array<double>")
    asked = vec.where("file_id % 100 = 0 OR file_id > 700").select(F.col("file_id").alias("query_id"), "embedding")
    got = vectors.batch_similarity(vec, asked)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 11 * 704
    told = {(r.query_id, r.file_id): r.score for r in got.collect()}
    other = vec.crossJoin(asked.withColumnRenamed("embedding", "q")).select("query_id", "file_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    for r in other.collect():
        assert (told[r.query_id, r.file_id] is None) == (r.score is None) and abs((r.score or 0) - (told[r.query_id, r.file_id] or 0)) < 2e-6, r
