import numpy as np
import pytest

from cairnspark.operators.agreement import adjusted_rand_index
from cairnspark.operators.components import connected_components
from cairnspark.operators.density import dbscan
from cairnspark.operators.kmeans import afkmc2_seeds, kmeans, local_trials, pick_seeder
from cairnspark.sources.points import from_numpy, make_blobs, to_numpy


def labels(spark, x, eps, min_pts, strategy="auto"):
    found = dbscan(from_numpy(spark, np.array(x, dtype=float)), eps, min_pts, strategy)
    return to_numpy(found.labels).tolist(), found.n_clusters


TWO_LINES = [(0.1 * i, 0) for i in range(5)] + [(10 + 0.1 * i, 0) for i in range(5)]


def test_two_lines(spark):
    assert labels(spark, TWO_LINES, 0.3, 2) == ([0] * 5 + [1] * 5, 2)


def test_isolated_point_is_noise(spark):
    assert labels(spark, [(0.1 * i, 0) for i in range(5)] + [(1000, 1000)], 0.3, 2) == ([0] * 5 + [-1], 1)


def test_border_takes_the_lowest_group(spark):
    x = [-0.6, -0.4, -0.2, 0, 1.8, 2, 2.2, 2.4, 0.9]
    assert labels(spark, [(v, 0) for v in x], 1.0, 4)[0] == [0, 0, 0, 0, 1, 1, 1, 1, 0]


@pytest.mark.parametrize("d", [4, 32])
def test_plans_agree(spark, d):
    rng = np.random.default_rng(d)
    x = np.vstack([c + rng.normal(0, 0.05, (30, d)) for c in (-10, 0, 10)])
    radius = 0.05 * np.sqrt(d) * 2
    assert labels(spark, x, radius, 4, "grid") == labels(spark, x, radius, 4, "block") == ([0] * 30 + [1] * 30 + [2] * 30, 3)


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_duplicates(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert labels(spark, [(0, 0)] * 60 + [(9, 9)] * 60, 0.5, 5) == ([0] * 60 + [1] * 60, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dbscan_limits(spark):
    with pytest.raises(ValueError):
        labels(spark, TWO_LINES, 0.3, 0)
    with pytest.raises(ValueError):
        labels(spark, TWO_LINES, float("nan"), 2)
    assert dbscan(from_numpy(spark, np.array(TWO_LINES)).where("id < 0"), 0.3, 2).labels.count() == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_match_union_find(spark, one_task):
    rng = np.random.default_rng(1)
    edges = rng.integers(0, 300, (220, 2))
    edges = np.vstack((edges, [(i, i + 1) for i in range(1000, 1100)], [(7, 7)]))
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges.tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(edges.tolist(), "src long, dst long"), one_task=one_task)
    assert {r.id: r.component for r in found.collect()} == {a: find(a) for a in {v for e in edges.tolist() for v in e}}


def blobs(n=300, d=3, k=4, seed=0):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, k, n)
    x = rng.normal(0, 0.5, (n, d))
    x[:, 0] += 50 * truth
    return x, truth


@pytest.mark.parametrize("seeder", [None, afkmc2_seeds])
def test_kmeans_recovers_groups(spark, seeder):
    x, truth = blobs()
    found = kmeans(from_numpy(spark, x), 4, seed=3, n_init=2, seeder=seeder)
    truth = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "id long, label int")
    assert adjusted_rand_index(truth, found.labels).first().ari == 1.0
    own = found.centroids[to_numpy(found.labels)]
    assert np.isclose(found.inertia, ((x - own) ** 2).sum())
    d2 = ((x[:, None] - found.centroids[None]) ** 2).sum(axis=2)
    assert (d2.argmin(axis=1) == to_numpy(found.labels)).all()


def test_kmeans_edges(spark):
    x, _ = blobs(20)
    one = kmeans(from_numpy(spark, x), 1)
    assert np.allclose(one.centroids[0], x.mean(axis=0)) and one.converged
    assert kmeans(from_numpy(spark, x), 20, seed=1).inertia < 1e-9
    for bad in ({"k": 0}, {"k": 21}, {"k": 2, "max_iter": 0}, {"k": 2, "tol": -1.0}, {"k": 2, "n_init": 0}):
        with pytest.raises(ValueError):
            kmeans(from_numpy(spark, x), **bad)


def test_kmeans_fills_empty_groups(spark):
    x = np.array([[(i % 4) + 0.001 * i] * 3 for i in range(16)])
    found = kmeans(from_numpy(spark, x), 12, max_iter=50, init=np.repeat(x[:1], 12, axis=0) + np.arange(12)[:, None] * 1e-9)
    assert found.n_iter <= 50 and len(set(to_numpy(found.labels).tolist())) == 12


def test_seeder_choice():
    assert [local_trials(k) for k in (1, 2, 8)] == [1, 2, 4]
    assert pick_seeder(500_000, 2, 100) is afkmc2_seeds
    assert pick_seeder(5000, 16, 16, best_of=True) is afkmc2_seeds
    assert pick_seeder(5000, 16, 16) is not afkmc2_seeds


def test_dbscan_on_generated_blobs(spark):
    data = make_blobs(spark, 1500, centers=5, seed=2).persist()
    found = dbscan(data.select("id", "features"), 3.0, 5)
    assert adjusted_rand_index(data.select("id", "label"), found.labels).first().ari > 0.95
