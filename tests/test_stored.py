"""Bucketed tables, stored hash trees and the index of deletions against plain code."""

import glob
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrydex.operators import checkpoints, search
from quarrydex.operators.fuzzy import FuzzyNames, query_keys
from quarrydex.sources.buckets import BucketTable


def files_under(path):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_upsert_touches_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(500)], "id bigint, value string")
    first = BucketTable.create(rows, path, ["id"], 32)
    before = files_under(path)
    new = spark.createDataFrame([("new", 3, 1), ("newer", 3, 2), ("x", 1000, 1)], "value string, id bigint, at int")
    second = first.upsert(new, [F.desc("at")])
    assert dict(map(tuple, second.read().collect())) == {**{i: f"v{i}" for i in range(500)}, 3: "newer", 1000: "x"}
    after = files_under(path)
    assert {p: t for p, t in after.items() if p in before} == before and len(after) - len(before) <= 2
    untouched = [b for b, v in second.versions.items() if v == 0]
    assert len(untouched) >= 30
    assert dict(map(tuple, first.read().collect()))[3] == "v3"  # the version that was opened stays readable
    third = second.delete(spark.createDataFrame([(1000,), (7,), (12345,)], "id bigint"))
    opened = BucketTable.open(spark, path)
    assert opened.version == 2 and opened.versions == third.versions and opened.read().count() == 499
    assert [r.value for r in opened.lookup(spark.createDataFrame([(3,), (7,)], "id bigint")).collect()] == ["newer"]
    with pytest.raises(Exception):
        second.upsert(new.limit(1))  # another writer was there first
    assert BucketTable.open(spark, path).version == 2 and BucketTable.open(spark, path, 0).read().count() == 500


def test_bucket_table_of_nothing(spark, tmp_path):
    empty = BucketTable.create(spark.createDataFrame([], "id bigint, value string"), str(tmp_path / "e"), ["id"], 4)
    assert empty.read().collect() == []
    one = empty.upsert(spark.createDataFrame([(None, "n"), (1, None)], "id bigint, value string"))
    assert sorted(map(tuple, one.read().collect()), key=str) == [(1, None), (None, "n")]
    assert one.delete(spark.createDataFrame([(1,)], "id bigint")).read().collect() == [(None, "n")]


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    at = datetime(2024, 1, 1)
    before = [(f"n{k % 3}", f"f{k}", f"h{k}", at) for k in range(3000)]
    after = [r for r in before if r[1] != "f17"] + [("n0", "extra", None, None)]
    after = [(n, f, "changed" if f in ("f5", "f2000") else h, t) for n, f, h, t in after]
    schema = "node_id string, file_id string, content_hash string, last_updated timestamp"
    for rows, name in ((before, "a"), (after, "b")):
        checkpoints.store(spark.createDataFrame(rows, schema), str(tmp_path / name))
    got = checkpoints.differences(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(map(tuple, got.collect())) == [("n0", "extra", "added"), ("n2", "f17", "removed"), ("n2", "f2000", "changed"), ("n2", "f5", "changed")]
    trees = [spark.read.parquet(str(tmp_path / n / "tree")) for n in "ab"]
    ranges = checkpoints.differing(*trees)
    assert {r.node_id for r in ranges.collect()} == {"n0", "n2"} and ranges.count() == 4
    read = sum(spark.read.parquet(str(tmp_path / "a" / "files")).where(F.col("folder") == r.prefix[:2]).count() for r in ranges.collect())
    assert read < 3000 * 0.04
    root = trees[0].where("level = 0 and node_id = 'n1'").first()
    assert root.files == 1000 and root.digest == trees[1].where("level = 0 and node_id = 'n1'").first().digest
    assert checkpoints.differences(spark, str(tmp_path / "a"), str(tmp_path / "a")).count() == 0


def test_fuzzy_index_equals_comparing_all(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 5, 6, 40])))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(4)))) for i in range(250)] + [(900, None), (901, "x" * 33 + " ABC"), (901, "abc-abd")]
    names = spark.createDataFrame(rows, "file_id bigint, name string")
    index = FuzzyNames.build(names, str(tmp_path / "f"))
    for query in ("abc", "ABCé", "a", "xyzxyz", "x" * 31, "x" * 35, rows[3][1].split(" ")[0] or "b"):
        for d in (0, 1, 2):
            want = sorted(map(tuple, search.fuzzy_names(names, query, d).distinct().collect()))
            assert sorted(map(tuple, index.search(query, d).collect())) == want, (query, d)
    assert query_keys("ab", 2) == ["", "a", "ab", "b"]
    with pytest.raises(ValueError):
        index.search("a", 3)


def test_a_level_of_a_stored_tree_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('n', id % 3) AS node_id", "cast(id AS string) AS file_id", "'h' AS content_hash", "timestamp'2024-01-01' AS last_updated")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join small parts again
    try:
        checkpoints.store(rows, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "s" / "tree" / "level=3").glob("*.parquet"))) > 1
    stored = spark.read.parquet(str(tmp_path / "s" / "tree"))
    want = checkpoints.tree(rows).collect()
    assert sorted(map(tuple, stored.select("node_id", "prefix", "files", "digest").collect())) == sorted(map(tuple, want))


def test_a_stored_snapshot_deals_each_row_out_once(spark, tmp_path):
    """Of several rows of a file on a node the first by the order is kept; the tree is made where the rows are, and what is alike isn't dealt out."""
    sc = spark.sparkContext

    def shuffled(run) -> int:
        """Records that the stages of ``run`` shuffled."""
        jvm, listed = sc._jvm, lambda: {s.stageId(): s.shuffleWriteRecords() for s in found()}
        empty = jvm.java.util.ArrayList
        found = lambda: list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(empty(), False, False, sc._gateway.new_array(jvm.double, 0), empty())))
        before = listed()
        run()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(n for stage, n in listed().items() if stage not in before)

    many, nodes = 20_000, 40
    base = spark.range(many).selectExpr("id AS file_id", f"id % {nodes} AS node_id", "'h' AS content_hash", "timestamp_ntz'2024-01-01 00:00:00' AS last_updated", "1 AS line")
    older = base.where("file_id < 3").withColumns({"content_hash": F.lit("old"), "line": F.lit(0)})
    changed = base.withColumn("content_hash", F.when(F.col("file_id") == 5, "new").otherwise(F.col("content_hash")))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert shuffled(lambda: checkpoints.store(base.unionByName(older), a, [F.desc("last_updated"), F.desc("line")])) < 1.5 * many
    checkpoints.store(changed, b)
    plain = checkpoints.tree(base.withColumn("last_updated", F.col("last_updated").cast("timestamp"))).collect()
    stored = spark.read.parquet(f"{a}/tree").select(F.col("node_id").cast("bigint").alias("node_id"), "prefix", "files", "digest").collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, plain))
    got = []
    assert shuffled(lambda: got.extend(checkpoints.differences(spark, a, b).collect())) < 0.1 * many
    assert [tuple(r) for r in got] == [("5", "5", "changed")]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_ranges_are_looked_up_or_dealt_out_alike(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(checkpoints, "MOST_NODES", most)
    at = datetime(2024, 1, 1)
    before = [(f"n{k % 7}", f"f{k}", f"h{k}", at) for k in range(500)]
    after = [(n, f, None if k % 50 == 3 else h, t) for k, (n, f, h, t) in enumerate(before) if k % 60 != 1] + [("new", "f1", "x", None)]
    schema = "node_id string, file_id string, content_hash string, last_updated timestamp"
    for rows, name in ((before, "a"), (after, "b"), ([], "none")):
        checkpoints.store(spark.createDataFrame(rows, schema), str(tmp_path / name))
    left, right = ({(n, f): h for n, f, h, _ in rows} for rows in (before, after))
    want = [(*k, "added" if k not in left else "removed" if k not in right else "changed") for k in left.keys() | right.keys() if left.get(k, 0) != right.get(k, 0)]
    got = lambda x, y: sorted(map(tuple, checkpoints.differences(spark, str(tmp_path / x), str(tmp_path / y)).collect()))
    assert got("a", "b") == sorted(want) and len(want) > 15
    assert got("none", "a") == sorted((n, f, "added") for n, f, _, _ in before) and got("none", "none") == []
