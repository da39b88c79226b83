"""The pipeline's near-duplicate stage decides by whole shingle sets."""

import random

import numpy as np
import pytest

from quarrydex.llm import simhash

SCHEMA = "doc_id bigint, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]


@pytest.mark.parametrize("large", [simhash.LARGE_WIDE, 8])
def test_pairs_at_the_limit(spark, monkeypatch, large):
    """Short texts of similarity 0.8 and a little more are linked, longer ones a little below it are not."""
    monkeypatch.setattr(simhash, "LARGE_WIDE", large)
    rng, rows, want = random.Random(15), [], {}
    for n, more, alike in [(8, 1, True), (9, 1, True), (16, 3, True), (60, 14, True), (60, 15, False), (200, 49, True), (200, 50, False), (7, 1, False)] * 8:
        text, i = words(rng, n), len(rows)
        rows += [(i, " ".join(text)), (i + 1, " ".join(text + words(rng, more)))]
        want |= {i: i, i + 1: i if alike else i + 1}
    # a chain: neighbours are similar, the ends aren't; a group of copies of which each is similar to the first
    text = words(rng, 60)
    for k in range(20):
        rows.append((1000 + k, " ".join(text)))
        want[1000 + k] = 1000
        text = text[3:] + words(rng, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == want


@pytest.mark.parametrize("few", [2, 10**9])
def test_set_similarity_is_exact(monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400)
    sets = [np.unique(np.concatenate((base[rng.random(400) < rng.choice([0.5, 0.9, 1])], rng.integers(0, 1 << 62, rng.integers(0, 90))))) for _ in range(60)]
    bucket = np.repeat([3, 5], 30)
    held = simhash.Sets([x.astype("<u8").tobytes() for x in sets], bucket, 0.8)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    i, j = i[(i < j) & (bucket[i] == bucket[j])], j[(i < j) & (bucket[i] == bucket[j])]
    want = [len(np.intersect1d(sets[p], sets[q])) >= 0.8 * len(np.union1d(sets[p], sets[q])) for p, q in zip(i, j)]
    assert held.alike(i, j).tolist() == want and 0 < sum(want) < len(want)


def test_case_and_punctuation_make_no_other_words(spark):
    rng = random.Random(4)
    text = words(rng, 40)
    rows = [(0, " ".join(text)), (1, ", ".join(text).upper() + "."), (2, "!!! ???"), (3, "$$$ %%%"), (4, "!!!  ???")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}


def test_radius_holds_for_short_texts():
    assert abs(1024 * simhash.differing(4, 5, 4) - 192) < 1e-6
    assert simhash.differing(5, 5, 5) == 0
    assert simhash.radius_of(0.8) > 192 + 4 * 12.5


def test_first_sets_go_to_the_parts_of_their_group_only(spark):
    """A small group has its first set once, a large one once for each of its parts, and every row meets it."""
    large = 5 * simhash.PER_PART
    rows = [(r, 10 * r + k, b"p%d" % k, b"s%d" % r) for r in range(1, 40) for k in range(3)] + [(10_000, 10_000 + k, b"p", b"large") for k in range(large)]
    rows = [(i if r < 10_000 and i % 10 == 0 else r, i, p, s) for r, i, p, s in rows]
    rows = [(10 * r if r < 10_000 and i % 10 else r, i, p, s) for r, i, p, s in rows]
    held = spark.createDataFrame(rows, "root bigint, id bigint, print binary, shingles binary")
    salted, first = simhash.with_first(held)
    counts = {r.root: r["count"] for r in first.groupBy("root").count().collect()}
    assert counts.pop(10_000) == 5 and set(counts.values()) == {1} and len(counts) == 39
    met = salted.join(first, ["root", "salt"])
    assert sorted(r.id for r in met.select("id").collect()) == sorted(i for _, i, _, _ in rows)
    assert met.where("root = 10000").groupBy("salt").count().agg({"count": "max"}).first()[0] < 2 * simhash.PER_PART


def test_only_candidates_texts_are_dealt_out(spark, monkeypatch):
    """Ids of candidates are sent to the texts, which stay where they are; with too many of them the result is the same."""
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(60))
    docs = spark.createDataFrame([(k, text(k if k >= 4 else 0)) for k in range(30)], "id bigint, text string")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a bigint, b bigint")
    plans, plain = {}, simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lambda: sorted(tuple(sorted(r)) for r in simhash.similar_links(docs, links, 1024, 0.8).collect())
        one = found()
        assert "BroadcastHashJoin" in plans["candidate-sets"] and "SortMergeJoin" not in plans["candidate-sets"]
        monkeypatch.setattr(simhash, "MOST_SENT", 0)
        assert found() == one == [(0, 1), (0, 2), (0, 3)]
        assert "SortMergeJoin" in plans["candidate-sets"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
