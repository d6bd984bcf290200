"""What the comparisons of blocks move and write, and that cuts, sizes and equal points don't change results."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.operators import blocks, knn, mst
from cairnspark.operators.density import dbscan
from cairnspark.operators.knn import knn_graph, knn_join
from cairnspark.operators.range_join import range_join
from cairnspark.plans import scratch
from cairnspark.sources.points import from_numpy, to_numpy


def written(before):
    paths = [p.removeprefix("file://") for p in scratch._written[before:]]
    return sum(os.path.getsize(os.path.join(folder, f)) for p in paths for folder, _, files in os.walk(p) for f in files)


def test_dbscan_writes_no_pairs(spark):
    x = np.random.default_rng(1).normal(0, 0.01, (3000, 8))
    before = len(scratch._written)
    found = dbscan(from_numpy(spark, x), 1.0, 5)
    assert found.n_clusters == 1 and to_numpy(found.points, "degree").tolist() == [3000] * 3000
    assert written(before) < 1_500_000  # its 4.5 million pairs took more


@pytest.mark.parametrize("d", [2, 8])
def test_dbscan_over_many_blocks(spark, d, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 32)
    rng = np.random.default_rng(d)
    x = np.vstack((rng.normal(0, 1, (500, d)), np.zeros((60, d)), rng.normal(0, 1, (40, d)) + 1e6)).astype(float)
    radius, n = 0.15 if d == 2 else 1.3, len(x)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius * radius
    core = near.sum(axis=1) >= 5
    own = np.where(core, np.arange(n), n)
    while True:  # the smallest core that cores reach
        lower = np.where(core, np.where(near & core[None, :], own[None, :], n).min(axis=1), n)
        if (lower == own).all():
            break
        own = lower
    number = {c: k for k, c in enumerate(sorted(set(own[core].tolist())))}
    want = [number[own[i]] if core[i] else min((number[own[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(n)]
    found = dbscan(from_numpy(spark, x), radius, 5)
    assert to_numpy(found.labels).tolist() == want and to_numpy(found.points, "degree").tolist() == near.sum(axis=1).tolist()


def test_knn_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 32)
    rng = np.random.default_rng(3)
    x = np.vstack((rng.integers(0, 9, (300, 2)).astype(float), np.zeros((40, 2)), rng.normal(0, 1, (60, 2)) + 100, [[1e5, 0]]))
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    want = {(i, r + 1): (int(j), d2[i, j]) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d2[i]))[:5])}
    assert {(r.id, r.rank): (r.nbr, r.d2) for r in knn_join(from_numpy(spark, x), 5).collect()} == want


def test_far_blocks_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 64)
    x = from_numpy(spark, np.random.default_rng(4).random((2000, 2)))
    met = []
    meet = blocks.meet
    for module in ("knn", "mst"):
        monkeypatch.setattr(f"cairnspark.operators.{module}.meet", lambda left, pairs, *a, **b: met.append(len(pairs)) or meet(left, pairs, *a, **b))
    edges, _ = mst.boruvka_mst(x, 4)
    assert edges.count() == 1999 and len(met) == 4
    assert met[0] == met[2] == 16 and max(met) < 120 * 2 // 3  # of 120 pairs of 16 blocks


def test_prim_of_many_points_is_exact(spark, monkeypatch):
    x = from_numpy(spark, np.random.default_rng(5).normal(size=(300, 8)))
    want = {(r.u, r.v) for r in mst.prim_mst(x, 4)[0].collect()}
    total = mst.prim_mst(x, 4)[0].agg({"w": "sum"}).first()[0]
    monkeypatch.setattr(mst, "PRIM_ROWS", 100)
    monkeypatch.setattr(blocks, "FEW", 32)
    edges = mst.prim_mst(x, 4)[0].collect()
    assert np.isclose(sum(r.w for r in edges), total, rtol=1e-12) and len({(r.u, r.v) for r in edges}) == len(want) == 299


def test_ties_of_the_tree_and_rounds_of_joins(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 32)
    x = np.random.default_rng(6).integers(0, 6, (200, 2)).astype(float)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    core = np.sort(d2, axis=1)[:, 4]
    u, v = np.triu_indices(200, 1)
    w = np.maximum(np.maximum(core[u], core[v]), d2[u, v])
    parent, want = list(range(200)), set()
    for k in np.lexsort((v, u, w)).tolist():  # Kruskal
        a, b = u[k], v[k]
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        if a != b:
            parent[a] = b
            want.add((int(u[k]), int(v[k]), float(w[k])))
    for most in (mst.ONE_TREE, 0):
        monkeypatch.setattr(mst, "ONE_TREE", most)
        assert {tuple(r) for r in mst.boruvka_mst(from_numpy(spark, x), 4)[0].collect()} == want


def test_a_table_of_one_partition_is_joined_in_many_tasks(spark):
    a, b = (from_numpy(spark, np.arange(n)[:, None] % 50.0).coalesce(1) for n in (6000, 1500))
    shares = [r["count"] for r in range_join(a, b, 1.0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 6000 * 1500 // 50 * 3 - 2 * 120 * 30 and len(shares) > 3


def test_graph_is_the_same_over_many_blocks(spark, monkeypatch):
    x = from_numpy(spark, np.random.default_rng(8).normal(size=(300, 6)).astype(np.float32).astype(float))
    want = sorted(map(tuple, knn_graph(x, 5, max_iter=2).collect()))
    moved = []
    local = knn.deal
    monkeypatch.setattr(knn, "deal", lambda *a, **b: moved.append(local(*a, **b)) or moved[-1])
    monkeypatch.setattr(blocks, "FEW", 32)
    assert sorted(map(tuple, knn_graph(x, 5, max_iter=2).collect())) == want
    assert (moved[0].sizes > 0).sum() == 9 and moved[0].single
