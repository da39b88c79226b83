"""Neighbours by cells against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrydex.operators import vectors
from quarrydex.operators.cells import Cells

SCHEMA = "file_id bigint, node_id int, embedding array<float>"


def clustered(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = middle[rng.integers(0, 12, n)] + spread / np.sqrt(dim) * rng.normal(size=(n, dim))
    return [(i, i % 5, [float(v) for v in row]) for i, row in enumerate(x)]


def test_same_rows_as_comparing_all(spark, tmp_path):
    rows = clustered(1500, 24, 1)
    rows += [(5000, 1, [0.0] * 24), (5001, 1, rows[0][2]), (5002, 2, rows[0][2]), (5003, 2, None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = Cells.build(table, str(tmp_path / "cells"), 24)
    asked = [r for r in rows if r[0] % 50 == 0 and r[2]]
    got = {}
    for r in index.neighbours(spark.createDataFrame([(i, v) for i, _, v in asked], "query_id bigint, embedding array<float>"), 7, block=16).collect():
        got.setdefault(r.query_id, []).append((r.file_id, r.node_id, r.score))
    known = table.where("embedding is not null")
    for i, _, v in asked:
        if i != 5000:
            assert got[i] == [tuple(r) for r in vectors.knn(known, v, 7).collect()], i
    assert [x[2] for x in got[5000]] == [0.0] * 7  # without length: all are as near
    compared, of = index.compared
    assert of == len(asked) * 1503 and compared < 0.5 * of


def test_odd_tables(spark, tmp_path):
    none = Cells.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    assert none.neighbours(query).collect() == []
    few = Cells.build(spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, None, [0.0, 0.0])], SCHEMA), str(tmp_path / "few"))
    assert [tuple(r)[1:] for r in few.neighbours(query).collect()] == [(1, 1, 1, 1.0), (2, 1, 1, 1.0), (3, 2, None, 0.0)]
    assert few.neighbours(query, 0).collect() == [] and few.neighbours(query.limit(0)).collect() == []
    with pytest.raises(Exception):
        Cells.build(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0, 2.0])], SCHEMA).coalesce(1), str(tmp_path / "bad"))
