"""Neighbours against every row; the tree and its walk by themselves."""

import math

import numpy as np
from pyspark.sql import functions as F

from annalist.llm import kmeanstree as kt
from annalist.llm import queries


def true_neighbours(ids, rows, own, query, count):
    score = (rows * query).sum(axis=1)
    keep = ids != own
    order = np.lexsort((ids[keep], -score[keep]))[:count]
    return list(zip(ids[keep][order].tolist(), score[keep][order].tolist(), strict=True))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_query_reaches_its_recall(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, rows = table.vec_id.to_numpy(), np.stack(table.embedding).astype(np.float64)
    got = by_query(queries.QUERIES["op9_tree_neighbours"](spark, sf).collect())
    assert sorted(got) == sorted(ids[ids % 20 == 0].tolist())
    met = 0
    for own, found in got.items():
        want = true_neighbours(ids, rows, own, rows[ids == own][0], 20)
        met += len({i for i, _ in want} & {i for i, _ in found})
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        true = {i: s for i, s in zip(ids.tolist(), (rows * rows[ids == own][0]).sum(axis=1).tolist(), strict=True)}
        assert all(math.isclose(s, true[i], abs_tol=1e-12) for i, s in found)
    assert met / (20 * len(got)) >= 0.9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, rank string")


def test_a_vector_that_a_third_shares(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 600)]
    rows += [(i, [1.0] * 8) for i in range(600, 900)]
    settings = kt.Settings(neighbours=5, sample=300, leaf_rows=16, task_rows=64, recall=1.0, trials=1000)
    got = by_query(kt.search(frame(spark, rows), F.col("vec_id") % 10 == 0, settings=settings).collect())
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(np.float64)
    for own, found in got.items():
        want = true_neighbours(ids, matrix, own, matrix[ids == own][0], 5)
        assert [i for i, _ in found] == [i for i, _ in want]
    assert [i for i, _ in got[890]][:1] == [i for i, _ in true_neighbours(ids, matrix, 890, matrix[890], 5)][:1]


def test_unsound_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 5.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (20, [3.0, 1.0]), (20, [3.0, 1.0]), (40, [0.0, 0.0])]
    got = by_query(kt.search(frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert got == {0: [(20, 3.0), (20, 3.0), (1, 2.0), (2, -1.0)], 20: [(1, 6.0), (0, 3.0), (2, 2.0)]}
    assert kt.search(frame(spark, [(6, None), (0, [0.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert kt.search(frame(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert kt.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


def test_the_walk_opens_every_leaf_and_the_nearest_first():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 6))
    tree = kt.grow(rows, kt.Settings(leaf_rows=20, branches=4))
    leaf = kt.leaf_of(rows, tree)
    assert set(leaf.tolist()) == set(range(tree.leaves))
    first = 0
    for k in range(50):
        walk = list(kt.best_bins(rows[k], tree))
        assert sorted(walk) == list(range(tree.leaves))
        first += walk.index(leaf[k]) < 3
    assert first > 40
    equal = kt.grow(np.ones((300, 3)), kt.Settings(leaf_rows=20))
    assert equal.leaves == 1
